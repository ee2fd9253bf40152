"""Closed schemas of the evidence tables, and the enumerations and dimensions they draw on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations, display categories, adjective bands and id patterns of the evidence model.
SOURCE_TYPES = [
    "sales_call", "renewal_call", "churn_interview", "cs_call", "internal_meeting", "nps_survey", "csat_survey", "general_survey",
    "review", "support_ticket", "feature_request", "competitive_intel", "advisory", "community", "internal_notes", "other",
]
CATEGORIES = {
    "Calls": ["sales_call", "renewal_call", "churn_interview", "cs_call", "internal_meeting"],
    "Surveys": ["nps_survey", "csat_survey", "general_survey"],
    "Reviews": ["review"],
    "Support": ["support_ticket"],
    "Feature Requests": ["feature_request"],
    "Competitive Intel": ["competitive_intel"],
    "Advisory": ["advisory"],
    "Community": ["community"],
    "Notes": ["internal_notes"],
    "Other": ["other"],
}
LIFECYCLES = ["prospect", "active", "churned", "unknown"]
SENTIMENTS = ["positive", "negative", "mixed", "neutral"]
THEME_TYPES = ["complaint", "praise", "feature_request", "competitive", "behavioral", "risk", "other"]
QUALITIES = ["good", "bad"]
INTERACTION_TYPES = ["single", "survey_responses", "reviews", "tickets", "deals", "requests", "other_multi"]
UNKNOWN_SEGMENT = "unknown"
BANDS = [(30, 101, "dominant primary leading top"), (15, 30, "significant common frequent widespread"), (5, 15, "notable moderate emerging"), (0, 5, "minor limited rare")]
MENTION_ID, QUESTION_ID, THEME_ID = r"^[a-zA-Z0-9_]+_Q\d+_\d+$", r"^Q\d+$", r"^Q\d+_T\d+$"


def category_of(source_type: Column) -> Column:
    """Display category of a source type; Other where it is none of them."""
    out = None
    for name, members in CATEGORIES.items():
        out = F.when(source_type.isin(members), name) if out is None else out.when(source_type.isin(members), name)
    return out.otherwise("Other")


# Schemas as DDL, so that they can be named before there is a session.
FILES = (
    "file_id string not null, source_type string not null, company string not null, lifecycle string not null, segment string not null, quality string not null, "
    "summary string not null, excluded boolean, exclusion_reason string, interaction_count int, interaction_type string, interaction_note string"
)
QUESTIONS = ("question_id string not null, text string not null")
SEGMENTS = ("id string not null, label string not null, description string not null")
SEGMENT_ASSIGNMENTS = ("file_id string not null, segment_id string not null")
SOURCES = ("file_id string not null, text string not null")
MENTION = "mention_id:string,question_id:string,mention:string,quote:string,quote_attribution:string,sentiment:string,notable_quote:boolean"
MENTION_RECORDS = (f"file_id string not null, mentions array<struct<{MENTION}>>")
THEMES = ("question_id string, theme_id string, label string, description string, type string, `include` string, `exclude` string, example_mention string")
ASSIGNMENTS = ("question_id string, mention_id string, theme_id string")
VERDICTS = ("mention_id string, fingerprint string, verdict string, reason string, round int, line long")
DEVIATIONS = ("timestamp string, phase string, step string, category string, description string, resolution string, source_id string, question_id string, details string")
LEDGER_EVENTS = ("event string, key string, attempt int, at double")
ISSUES = ("entity_key string, check_name string, severity string, message string")
