"""Schemas, defaults and data-quality rules of the domain tables.

A ``TableSpec`` is all that a batch load needs: the columns, what a missing value becomes, which
values are legal and which parent a row must have. ``operators.validation`` applies it.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of the child refer to ``parent_columns`` of ``parent``; a NULL reference passes."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "restrict"


@dataclass(frozen=True)
class TableSpec:
    name: str
    ddl: str
    required: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    falsy_to_default: tuple[str, ...] = ()
    forced: dict[str, str] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()


INGREDIENT = "struct<name:string,quantity:string,unit:string>"
SHOPPING_ITEM = "struct<name:string,quantity:string,unit:string,purchased:boolean,recipe_id:string>"

# Legal values of the enumerated columns.
PRIORITIES = ("low", "medium", "high", "urgent")
MEAL_TYPES = ("breakfast", "lunch", "dinner", "snack")
INTERACTION_TYPES = ("meeting", "email", "call", "coffee", "event", "linkedin", "other")
OPPORTUNITY_STAGES = ("identified", "in_conversation", "proposal", "negotiation", "won", "lost")
COMPANY_SIZES = ("startup", "mid-market", "enterprise")
REMOTE_POLICIES = ("remote", "hybrid", "onsite")
POSTING_SOURCES = ("linkedin", "company-site", "referral", "recruiter", "other")
APPLICATION_STATUSES = ("draft", "applied", "screening", "interviewing", "offer", "accepted",
                        "rejected", "withdrawn")
INTERVIEW_TYPES = ("phone_screen", "technical", "behavioral", "system_design", "hiring_manager",
                   "team", "final")
INTERVIEW_STATUSES = ("scheduled", "completed", "cancelled", "no_show")
PROCESS_ROLES = ("recruiter", "hiring_manager", "referral", "interviewer", "other")
THOUGHT_TYPES = ("observation", "task", "idea", "reference", "person_note")
DAYS_OF_WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _owned(column: str, parent: str, on_delete: str = "restrict") -> ForeignKey:
    """Reference to a parent row of the same user."""
    return ForeignKey((column, "user_id"), parent, ("id", "user_id"), on_delete)


_ALL = [
    TableSpec(
        "thoughts",
        "id string, content string, embedding array<float>, metadata string, "
        "created_at timestamp, updated_at timestamp",
        required=("content",), defaults={"metadata": "'{}'"}),
    TableSpec(
        "household_items",
        "id string, user_id string, name string, category string, location string, details string, "
        "notes string, created_at timestamp, updated_at timestamp",
        required=("user_id", "name"), defaults={"details": "'{}'"},
        falsy_to_default=("category", "location", "details", "notes")),
    TableSpec(
        "household_vendors",
        "id string, user_id string, name string, service_type string, phone string, email string, "
        "website string, notes string, rating int, last_used date, created_at timestamp",
        required=("user_id", "name"),
        falsy_to_default=("service_type", "phone", "email", "website", "notes", "rating"),
        ranges={"rating": (1, 5)}),
    TableSpec(
        "maintenance_tasks",
        "id string, user_id string, name string, category string, frequency_days int, "
        "last_completed timestamp, next_due timestamp, priority string, notes string, "
        "created_at timestamp, updated_at timestamp",
        required=("user_id", "name"), defaults={"priority": "'medium'"},
        falsy_to_default=("category", "frequency_days", "priority", "notes"),
        enums={"priority": PRIORITIES}),
    TableSpec(
        "maintenance_logs",
        "id string, task_id string, user_id string, completed_at timestamp, performed_by string, "
        "cost decimal(10,2), notes string, next_action string",
        required=("task_id", "user_id"), defaults={"completed_at": "as_of"},
        falsy_to_default=("performed_by", "cost", "notes", "next_action"),
        foreign_keys=(_owned("task_id", "maintenance_tasks", "cascade"),)),
    TableSpec(
        "family_members",
        "id string, user_id string, name string, relationship string, birth_date date, notes string, "
        "created_at timestamp",
        required=("user_id", "name")),
    TableSpec(
        "activities",
        "id string, user_id string, family_member_id string, title string, activity_type string, "
        "day_of_week string, start_time string, end_time string, start_date date, end_date date, "
        "location string, notes string, created_at timestamp",
        required=("user_id", "title"), falsy_to_default=("family_member_id",),
        foreign_keys=(_owned("family_member_id", "family_members"),)),
    TableSpec(
        "important_dates",
        "id string, user_id string, family_member_id string, title string, date_value date, "
        "recurring_yearly boolean, reminder_days_before int, notes string, created_at timestamp",
        required=("user_id", "title", "date_value"),
        defaults={"recurring_yearly": "false", "reminder_days_before": "7"},
        falsy_to_default=("family_member_id", "reminder_days_before"),
        foreign_keys=(_owned("family_member_id", "family_members"),)),
    TableSpec(
        "recipes",
        "id string, user_id string, name string, cuisine string, prep_time_minutes int, "
        f"cook_time_minutes int, servings int, ingredients array<{INGREDIENT}>, "
        "instructions array<string>, tags array<string>, rating int, notes string, "
        "created_at timestamp, updated_at timestamp",
        required=("user_id", "name"),
        defaults={"tags": "cast(array() as array<string>)",
                  "ingredients": f"cast(array() as array<{INGREDIENT}>)",
                  "instructions": "cast(array() as array<string>)"},
        ranges={"rating": (1, 5)}),
    TableSpec(
        "meal_plans",
        "id string, user_id string, week_start date, day_of_week string, meal_type string, "
        "recipe_id string, custom_meal string, servings int, notes string, created_at timestamp",
        required=("user_id", "week_start", "day_of_week", "meal_type"),
        falsy_to_default=("recipe_id", "custom_meal", "servings", "notes"),
        enums={"meal_type": MEAL_TYPES},
        foreign_keys=(_owned("recipe_id", "recipes"),)),
    TableSpec(
        "shopping_lists",
        f"id string, user_id string, week_start date, items array<{SHOPPING_ITEM}>, notes string, "
        "created_at timestamp, updated_at timestamp",
        required=("user_id", "week_start"),
        defaults={"items": f"cast(array() as array<{SHOPPING_ITEM}>)"}),
    TableSpec(
        "professional_contacts",
        "id string, user_id string, name string, company string, title string, email string, "
        "phone string, linkedin_url string, how_we_met string, tags array<string>, notes string, "
        "last_contacted timestamp, follow_up_date date, created_at timestamp, updated_at timestamp",
        required=("user_id", "name"), defaults={"tags": "cast(array() as array<string>)"},
        falsy_to_default=("company", "title", "email", "phone", "linkedin_url", "how_we_met", "notes")),
    TableSpec(
        "contact_interactions",
        "id string, contact_id string, user_id string, interaction_type string, "
        "occurred_at timestamp, summary string, follow_up_needed boolean, follow_up_notes string, "
        "created_at timestamp",
        required=("contact_id", "user_id", "interaction_type", "summary"),
        defaults={"occurred_at": "as_of", "follow_up_needed": "false"},
        falsy_to_default=("follow_up_notes",), enums={"interaction_type": INTERACTION_TYPES},
        foreign_keys=(_owned("contact_id", "professional_contacts", "cascade"),)),
    TableSpec(
        "opportunities",
        "id string, user_id string, contact_id string, title string, description string, "
        "stage string, value decimal(12,2), expected_close_date date, notes string, "
        "created_at timestamp, updated_at timestamp",
        required=("user_id", "title"), defaults={"stage": "'identified'"},
        falsy_to_default=("contact_id", "description", "stage", "value", "notes"),
        enums={"stage": OPPORTUNITY_STAGES},
        foreign_keys=(_owned("contact_id", "professional_contacts", "set_null"),)),
    TableSpec(
        "companies",
        "id string, user_id string, name string, industry string, website string, size string, "
        "location string, remote_policy string, notes string, glassdoor_rating decimal(2,1), "
        "created_at timestamp, updated_at timestamp",
        required=("user_id", "name"),
        falsy_to_default=("industry", "website", "size", "location", "remote_policy", "notes",
                          "glassdoor_rating"),
        enums={"size": COMPANY_SIZES, "remote_policy": REMOTE_POLICIES},
        ranges={"glassdoor_rating": (1.0, 5.0)}),
    TableSpec(
        "job_postings",
        "id string, company_id string, user_id string, title string, url string, salary_min int, "
        "salary_max int, salary_currency string, requirements array<string>, "
        "nice_to_haves array<string>, notes string, source string, posted_date date, "
        "closing_date date, created_at timestamp",
        required=("company_id", "user_id", "title"),
        defaults={"salary_currency": "'USD'", "requirements": "cast(array() as array<string>)",
                  "nice_to_haves": "cast(array() as array<string>)"},
        falsy_to_default=("url", "salary_min", "salary_max", "salary_currency", "notes", "source"),
        enums={"source": POSTING_SOURCES},
        foreign_keys=(_owned("company_id", "companies", "cascade"),)),
    TableSpec(
        "applications",
        "id string, job_posting_id string, user_id string, status string, applied_date date, "
        "response_date date, resume_version string, cover_letter_notes string, "
        "referral_contact string, notes string, created_at timestamp, updated_at timestamp",
        required=("job_posting_id", "user_id"), defaults={"status": "'applied'"},
        falsy_to_default=("status", "resume_version", "cover_letter_notes", "referral_contact", "notes"),
        enums={"status": APPLICATION_STATUSES},
        foreign_keys=(_owned("job_posting_id", "job_postings", "cascade"),)),
    TableSpec(
        "interviews",
        "id string, application_id string, user_id string, interview_type string, "
        "scheduled_at timestamp, duration_minutes int, interviewer_name string, "
        "interviewer_title string, status string, notes string, feedback string, rating int, "
        "created_at timestamp",
        required=("application_id", "user_id"), forced={"status": "'scheduled'"},
        falsy_to_default=("duration_minutes", "interviewer_name", "interviewer_title", "notes"),
        enums={"interview_type": INTERVIEW_TYPES, "status": INTERVIEW_STATUSES},
        ranges={"rating": (1, 5)},
        foreign_keys=(_owned("application_id", "applications", "cascade"),)),
    TableSpec(
        "job_contacts",
        "id string, user_id string, company_id string, name string, title string, email string, "
        "phone string, linkedin_url string, role_in_process string, "
        "professional_crm_contact_id string, notes string, last_contacted timestamp, "
        "created_at timestamp",
        required=("user_id", "name"), enums={"role_in_process": PROCESS_ROLES},
        foreign_keys=(_owned("company_id", "companies", "set_null"),)),
    TableSpec(
        "contacts",
        "id string, name string, email string, company string, role string, notes string, "
        "metadata string, created_at timestamp, updated_at timestamp",
        required=("name",), defaults={"metadata": "'{}'"}),
    TableSpec(
        "thought_interactions",
        "id string, contact_id string, thought_id string, interaction_type string, "
        "summary string, metadata string, created_at timestamp",
        required=("contact_id",), defaults={"metadata": "'{}'"},
        foreign_keys=(ForeignKey(("contact_id",), "contacts", ("id",), "cascade"),
                      ForeignKey(("thought_id",), "thoughts", ("id",), "set_null"))),
    TableSpec("households", "id string, name string, created_at timestamp", required=("name",)),
    TableSpec(
        "household_members",
        "household_id string, user_id string, role string",
        required=("household_id", "user_id"), defaults={"role": "'member'"},
        foreign_keys=(ForeignKey(("household_id",), "households", ("id",), "cascade"),)),
    TableSpec(
        "shared_shopping_lists",
        "id string, household_id string, item_name string, quantity int, created_by string, "
        "created_at timestamp",
        required=("item_name",),
        foreign_keys=(ForeignKey(("household_id",), "households", ("id",), "cascade"),)),
    TableSpec(
        "visible_recipes",
        "id string, user_id string, title string, ingredients array<string>, instructions string, "
        "visibility string, created_at timestamp",
        required=("title",), defaults={"visibility": "'private'"},
        enums={"visibility": ("public", "private")}),
    TableSpec(
        "shopping_list_items",
        "id string, item string, quantity string, purchased boolean, created_at timestamp",
        required=("item",), defaults={"quantity": "'1'"}, falsy_to_default=("quantity",),
        forced={"purchased": "false"}),
]

TABLES: dict[str, TableSpec] = {spec.name: spec for spec in _ALL}
