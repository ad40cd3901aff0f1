import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from keepsake.llm import personal_data as P
from keepsake.llm.queries import QUERIES

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    "write to a.b+c@mail.example.com, or x@y.z_d@e.f or a@b.c.d@e.f.g or @no.where or q@w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3",
    "card 4111 1111 1111 1111 and 4111111111111112 and 5500-0000-0000-0004 1 23", "+1 (988) 555-2485 or +12 3 or +49 30 1234567 8.",
    "né 🙂 漢 +1 (988) 555-2485 é a@b.co 10.0.0.1 4111111111111111", "", None, "a@b.co x", "+" * 50 + "1" * 12,
    "9" * 30_000, "a" * 20_000 + "@", "a." * 5_000 + "@b.c", "1." * 5_000, "+1" + "(" * 5_000, "12 " * 4_000,
    "+1 4111 1111 1111 1111", "999999999999.1.1.1 1.1.1.00000000255"]


def luhn(d):
    return sum(n - 9 if (n := int(c) * (2 if i % 2 else 1)) > 9 else n for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    found = []
    for k, kind in enumerate(P.KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d))
                    or kind == "phone" and not 10 <= len(d) <= 15):
                continue
            found.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_op4_query_against_brute_force(spark, folder_of, documents):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None), (None, TEXTS[1], "s")]
    docs = documents(rows).withColumn("base", F.lit(1)).withColumn("all", F.lit(2)).withColumn("email", F.lit("a@b.c"))
    found = QUERIES["op4_weak_pii"](spark, folder_of(documents=docs)).collect()
    assert len(found) == len(rows)
    for r in found:
        base = brute(TEXTS[1 if r["doc_id"] is None else r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s.startswith(k) for s in base) for k in P.KINDS]
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])


def test_votes_add_spans_and_leave_others(documents):
    rows = [(i, f"please email me at user{i}@site.com or call +1 (988) 555-24{i % 90 + 10} today", "s") for i in range(60)]
    rows += [(100, "call my phone (212) 555-0187 or mail jo (at) site (dot) com to user@site.org", "s"),
             (101, "sum 1234 5678 9012 3456 of parts", "s")]
    found = {r["doc_id"]: r for r in P.find_personal_data(documents(rows)).collect()}
    added = {found[100]["text"][s["start"]:s["end"]] for s in found[100]["spans"]} - {"user@site.org"}
    assert added == {"(212) 555-0187", "jo (at) site (dot) com"}
    assert found[101]["spans"] == []


def test_masked_text_and_empty_table(documents):
    docs = documents([(1, "a@b.co and 10.0.0.1!", "s")])
    one = P.find_personal_data(docs).select(P.masked_text(F.col("text"), F.col("spans")).alias("t")).first()
    assert one["t"] == "<email> and <ip>!"
    assert P.find_personal_data(documents([])).count() == 0


def wide_brute(text):
    base = [tuple(map(int, s.split(":")[1:])) for s in brute(text)]
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(P.KINDS) for m in re.finditer(P.WIDE[kind], text)
                  if not any(a < m.end() and m.start() < b for a, b in base))


def test_wide_candidates_and_context_against_brute_force(documents):
    rng = random.Random(5)
    parts = ["a@b.co", "jo (at) site (dot) com", "x@y.z [at] q.de", "10.0.0.1", "1:2:3:4:5:6:7:8", "4111 1111 1111 1111", "4111.1111.1111.1112",
             "1234 5678 9012 3456", "(212) 555-0187", "212-555-0187", "+1 (988) 555-2485", "call", "mail", "é🙂", "card", "12 12", "\n"]
    texts = [rng.choice([" ", "", " - "]).join(rng.choice(parts) for _ in range(rng.choice([3, 30, 700]))) for _ in range(60)]
    for r in P.candidates(documents([(i, t, "s") for i, t in enumerate(texts)])).collect():
        assert sorted((s["start"], s["kind"], s["end"]) for s in r["wide"]) == wide_brute(r["text"])
        for s in [*r["base"], *r["wide"]]:
            near = r["text"][max(0, s["start"] - 40):s["start"]]
            heard = re.search(P.CONTEXT[P.KINDS[s["kind"]]].replace("(?i)", ""), near, re.I)
            assert s["votes"] // 3 % 3 == (1 if heard else 2)


def test_many_matches_of_one_text_take_time_in_proportion(documents):
    took = []
    for n in (10_000, 20_000, 80_000):  # the first one warms up
        text = " ".join(f"u{i}@b.co" for i in range(n))
        docs, start = documents([(1, text, "s")]), time.monotonic()
        found = P.candidates(docs).select("base").first()["base"]
        took.append(time.monotonic() - start)
        assert [(s["start"], s["end"]) for s in found if s["kind"] == 0] == [m.span() for m in re.finditer(r"\S+", text)]
    assert took[2] < 8 * took[1] + 2
