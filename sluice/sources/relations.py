"""Literal relations of the self-assessment, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The answers that rules and lookups compare with, exactly.
QUESTIONS = (
    (
        "What does your organisation use AI for?",
        "Select all that apply",
        True,
        (
            "Screening CVs or job applications",
            "Credit scoring or insurance risk",
            "Eligibility for public benefits or services",
            "Safety-critical systems or infrastructure",
            "General productivity tools (Copilot, ChatGPT, etc.)",
            "We don't use AI yet",
        ),
    ),
    ("Is your organisation based in the EU or serving EU customers?", None, False, ("Yes", "No", "Not sure")),
    ("How many people work in your organisation?", None, False, ("Under 10", "10–50", "50–250", "250+")),
    ("When did you last review your AI policies or governance?", None, False, ("In the last 6 months", "Over a year ago", "Never", "We don't have any")),
)
HIGH_RISK_USES = (
    "Screening CVs or job applications",
    "Credit scoring or insurance risk",
    "Eligibility for public benefits or services",
    "Safety-critical systems or infrastructure",
)
LINKS = (("/", "Home"), ("/services", "Services"), ("/about", "About"), ("/contact", "Contact"))
DEADLINE = "2026-08-02T00:00:00Z"

# The heading that each result shows. Beside it, where a result leads.
RESULTS = (
    ("high", "Your systems likely fall under Annex III.", "/contact"),
    ("low", "You're likely outside the highest-risk categories.", "/services"),
    ("unsure", "Hard to say without a bit more context.", "/contact"),
)


def results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESULTS, "result string, heading string, link string")
