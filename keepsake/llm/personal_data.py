"""Personal data by weak supervision: labellers vote on candidate spans, expectation-maximisation estimates their
reliabilities, and a span classifier trained on the posterior decides. Column functions only."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import let, whole

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. The possessive quantifiers and the start conditions only keep the search linear: no class meets
# the character that must follow it, so a match can only begin where a run begins or a match has just ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider forms that only the votes can confirm.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}"
             r"(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9.-])[0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
HINT = {"email": "[@\\[(]", "ip": "[.:]", "card": "[0-9]", "phone": "[0-9]"}
CONTEXT = {"email": r"(?i)\b(e-?mail|mail|contact|write|reach)\b", "ip": r"(?i)\b(ip|host|server|address|ping|login)\b",
           "card": r"(?i)\b(card|visa|credit|debit|payment|account)\b",
           "phone": r"(?i)\b(phone|tel|telephone|call|mobile|fax|cell)\b"}
GAZETTEER = {"email": r"(?i)(com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$", "ip": r"^(?!0|127\.|255\.).*$",
             "card": r"^[3-6]", "phone": r"^(\+(1|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|\()"}
LABELLERS = ("pattern", "check", "gazetteer", "context", "company")
FOUND = "array<struct<start:int,end:int,value:string>>"
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"  # private use
BLOCK = 64  # numbers summed at once
CONTEXT_CHARS = 40  # code points before a span that the context labeller reads
CHUNK_CHARS = 1000


def _places(lengths: Column, levels: int = 2) -> Column:
    """For each number the sum of those before it. Sums of blocks of ``BLOCK`` numbers are summed first, so the work
    grows with the numbers; a list that grows by one number a step would be copied at each."""
    if not levels:
        return F.slice(F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n))),
                       1, F.size(lengths))
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda k: F.aggregate(F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda x, n: x + n))
    starts = let(sums, lambda of_blocks: _places(of_blocks, levels - 1))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    return let(starts, lambda known: F.transform(lengths, lambda _, i: F.aggregate(
        F.slice(lengths, block(i) * BLOCK + 1, i % BLOCK), F.get(known, block(i)), lambda x, n: x + n)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost, non-overlapping matches with their places in code points: the text is marked around each match,
    cut at the marks, and the lengths of the pieces add up. Marks in the text itself are other characters first.
    Every second piece is a match."""
    safe = F.translate(text, OPEN + CLOSE, OTHER + OTHER)
    pieces = F.split(F.regexp_replace(safe, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]")

    def spans(cut, places):
        return F.filter(F.transform(cut, lambda piece, i: F.struct(
            F.get(places, i).alias("start"), (F.get(places, i) + F.length(piece)).alias("end"), piece.alias("value"))),
            lambda _, i: i % 2 == 1)

    return let(pieces, lambda cut: let(F.transform(cut, lambda p: F.length(p)), lambda lengths: let(
        _places(lengths), lambda places: spans(cut, places))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def weighed(c, i):
        n = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check a match of the base pattern must pass."""
    if kind == "ip":
        return F.forall(F.split(value, "[.]"), lambda p: let(F.ltrim(p, F.lit("0")), lambda d: F.when(
            F.length(d) > 3, False).otherwise(F.coalesce(F.try_to_number(d, F.lit("999")), F.lit(0)) <= 255)))
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda s: passes(kind, s["value"]))
    return F.when(text.rlike(HINT[kind] if kind != "email" else "@"), found).otherwise(F.array().cast(FOUND))


def _meets(base: Column, span: Column) -> Column:
    """Whether a span overlaps one of ``base``, spans of one kind in order: the first that ends behind its start is found by bisection."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(base) + 1)).cast("int"))

    def halve(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        behind, is_open = F.get(base, middle)["end"] > span["start"], state["low"] < state["high"]
        return F.struct(F.when(is_open & ~behind, middle + 1).otherwise(state["low"]).alias("low"),
                        F.when(is_open & behind, middle).otherwise(state["high"]).alias("high"))

    first = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(base).alias("high")), halve, lambda state: state["low"])
    return F.coalesce(F.get(base, first)["start"] < span["end"], F.lit(False))


def wide_spans(text: Column, kind: str, base: list[Column]) -> Column:
    """Wider candidates, away from the base spans of every kind (``base``: one array per kind)."""
    found = F.filter(matches(text, WIDE[kind]), lambda s: ~reduce(or_, (_meets(b, s) for b in base)))
    return F.when(text.rlike(HINT[kind]), found).otherwise(F.array().cast(FOUND))


def _before(chunks: Column, start: Column) -> Column:
    """The code points before a place. They are taken from the chunks of the text that hold them: a substring of
    the text itself is counted from its beginning, for each span anew."""
    first = F.greatest(F.lit(0), start - CONTEXT_CHARS)
    chunk = F.floor(first / CHUNK_CHARS).cast("int")
    near = F.concat(F.get(chunks, chunk), F.coalesce(F.get(chunks, chunk + 1), F.lit("")))
    return F.substring(near, first - chunk * CHUNK_CHARS + 1, start - first)


def _vote(kind: str, chunks: Column, span: Column, strict: bool, company: Column) -> Column:
    """The votes as one number, a digit of base 3 each: 0 against, 1 for, 2 silent."""
    before = _before(chunks, span["start"])
    value, number = span["value"], digits(span["value"])
    sound = {"email": F.lit(2), "ip": F.lit(1 if strict else 2), "card": F.when(
        F.length(number).between(13, 19), F.when(luhn(number), 1).otherwise(0)).otherwise(0),
        "phone": F.when(F.length(number).between(9, 15), 1).otherwise(0)}[kind]
    ballots = [F.lit(1 if strict else 2), sound, F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(0),
               F.when(before.rlike(CONTEXT[kind]), 1).otherwise(2), F.when(company, 1).otherwise(2)]
    code = F.lit(0)
    for ballot in ballots:
        code = code * 3 + ballot
    return code.cast("int")


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, text, base, wide``: spans with kind number, strictness and votes. Nothing is shuffled."""
    text = F.col("text")
    rows = docs.select(docs["doc_id"].alias("doc_id"), whole(docs["text"]).alias("text"))

    def tagged(spans, kind, strict, company):
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(strict).alias("strict"), _vote(kind, F.col("chunks"), s, strict, company).alias("votes")))

    rows = rows.select("doc_id", "text", *[base_spans(text, k).alias(k) for k in KINDS])
    rows = rows.select("doc_id", "text", *KINDS, *[
        wide_spans(text, k, [F.col(b) for b in KINDS]).alias(f"wide_{k}") for k in KINDS])
    total = sum((F.size(F.col(k)) for k in [*KINDS, *[f"wide_{k}" for k in KINDS]]), F.lit(0))
    company = total > 1
    rows = rows.withColumn("chunks", F.when(total > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK_CHARS}}}+"), F.lit(0))))
    return rows.select(
        "doc_id", "text", F.concat(*[tagged(F.col(k), k, True, company) for k in KINDS]).alias("base"),
        F.concat(*[tagged(F.col(f"wide_{k}"), k, False, company) for k in KINDS]).alias("wide"))


def _ballots(code: int) -> list[int]:
    return [code // 3 ** k % 3 for k in range(len(LABELLERS) - 1, -1, -1)]


def reliabilities(patterns: list[tuple[int, int, int]], steps: int = 100) -> dict[tuple[int, int], float]:
    """P(personal data) for each (kind, votes). ``patterns``: (kind, votes, count). Each labeller's rates of
    approval for true and false spans are estimated from agreement, starting from the share of approving votes."""
    belief = {}
    for kind, code, _ in patterns:
        cast = [b for b in _ballots(code) if b != 2]
        belief[kind, code] = (sum(cast) + 0.5) / (len(cast) + 1)
    for _ in range(steps):
        prior = (sum(belief[k, c] * n for k, c, n in patterns) + 1) / (sum(n for *_, n in patterns) + 2)
        rates = []
        for at in range(len(LABELLERS)):
            yes, seen = [0.2, 1.6], [2.0, 2.0]  # false and true spans: assumed, before any are seen
            for k, c, n in patterns:
                ballot = _ballots(c)[at]
                if ballot != 2:
                    for side, p in ((0, 1 - belief[k, c]), (1, belief[k, c])):
                        seen[side] += p * n
                        yes[side] += p * n * ballot
            rates.append((yes[0] / seen[0], yes[1] / seen[1]))
        for k, c, _ in patterns:
            odds = math.log(prior / (1 - prior))
            for ballot, (false, true) in zip(_ballots(c), rates):
                if ballot == 1:
                    odds += math.log(true / false)
                elif ballot == 0:
                    odds += math.log((1 - true + 1e-9) / (1 - false + 1e-9))
            belief[k, c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def _inputs(kind: int, code: int) -> list[float]:
    ballots = _ballots(code)
    return [*(float(b == 1) for b in ballots), *(float(b == 0) for b in ballots), *(float(kind == k) for k in range(len(KINDS))), 1.0]


def span_classifier(patterns: list[tuple[int, int, int]], steps: int = 400) -> dict[tuple[int, int], float]:
    """Logistic regression on votes and kind, trained on the posterior as soft labels; its score of each pattern."""
    belief = reliabilities(patterns)
    weights = [0.0] * len(_inputs(0, 0))
    total = sum(n for *_, n in patterns) or 1

    def score(kind, code):
        z = sum(w * x for w, x in zip(weights, _inputs(kind, code)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    for _ in range(steps):
        slope = [0.0] * len(weights)
        for kind, code, n in patterns:
            gap = (belief[kind, code] - score(kind, code)) * n / total
            for i, x in enumerate(_inputs(kind, code)):
                slope[i] += gap * x
        weights = [w + 2.0 * s - 1e-3 * w for w, s in zip(weights, slope)]
    return {(k, c): score(k, c) for k, c, _ in patterns}


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, text, base, spans``: the base spans of each row, and with those that the classifier adds, as
    arrays of ``start, end, kind`` (number in ``KINDS``) in order of start, end and kind; ends are exclusive, places are code
    points.

    Votes are counted by pattern over all documents; there are at most kinds * 3 ** labellers patterns, so what
    reaches the driver has a fixed bound. Base spans always stay. Null text: an empty one, no spans. Repeated rows
    are each given theirs. An empty table gives no rows; other columns are ignored.
    """
    rows = candidates(docs)
    patterns = [tuple(r) for r in rows.select(F.explode(F.concat("base", "wide")).alias("s"))
                .groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()]
    accepted = [k * 1000 + c for (k, c), p in span_classifier(patterns).items() if p >= threshold]
    chosen = F.array(*[F.lit(a) for a in accepted]).cast("array<int>")
    plain = lambda spans: F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    added = F.filter("wide", lambda s: F.array_contains(chosen, s["kind"] * 1000 + s["votes"]))
    return rows.select("doc_id", "text", plain(F.col("base")).alias("base"),
                       plain(F.concat(F.col("base"), added)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def masked_text(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first one."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        fits = s["start"] >= state["at"]
        put = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))
        return F.struct(F.when(fits, s["end"]).otherwise(state["at"]).alias("at"),
                        F.when(fits, put).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
