"""Decisions as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the judged dimensions; correctness counts only where there is a reference.
JUDGE_WEIGHTS = {"faithfulness": 0.35, "answer_relevance": 0.25, "context_relevance": 0.15, "completeness": 0.15, "citation_accuracy": 0.10, "correctness": 0.30}
PASS, WARN = 0.40, 0.25
INTENTS = ("how_to", "troubleshooting", "complaint", "billing", "account", "escalation_request", "general")


def judge_overall(scores: dict[str, Column]) -> Column:
    """Weighted mean of the dimensions that have a score, 4 digits; null if none has."""
    total = sum((F.coalesce(c * JUDGE_WEIGHTS[n], F.lit(0.0)) for n, c in scores.items()), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(JUDGE_WEIGHTS[n])).otherwise(F.lit(0.0)) for n, c in scores.items()), F.lit(0.0))
    return F.when(weight > 0, F.round(total / weight, 4))


def metric_verdict(rouge_l: Column, rouge_1: Column) -> Column:
    s = F.coalesce(rouge_l, rouge_1)
    return F.when(s.isNull(), "unknown").when(s >= PASS, "pass").when(s >= WARN, "warn").otherwise("fail")


def answer_verdict(alignment: Column, judge: Column, confidence: Column) -> Column:
    """Off topic first, then what the judge says, then the confidence."""
    return (
        F.when(alignment < 0.30, "off_topic")
        .when(judge.isNotNull() & (judge < 0.60), "fail")
        .when(judge.isNull() & (confidence < 0.50), "low_confidence")
        .otherwise("pass")
    )


def runs_judge(alignment: Column, confidence: Column, asked: Column | None = None, banded: bool = False) -> Column:
    """Whether borderline scores call the judge. banded: alignment only from 0.30 to 0.65."""
    near = alignment.between(0.30, 0.65) if banded else alignment < 0.65
    return F.coalesce(asked if asked is not None else F.lit(False), F.lit(False)) | F.coalesce(near, F.lit(False)) | F.coalesce(confidence <= 0.72, F.lit(False))


def escalation(explicit: Column, intent: Column, no_answer: Column, verdict: Column) -> Column:
    """The reason to call a person, in order of priority; null if there is none."""
    return (
        F.when(explicit, "explicit_request")
        .when(intent == "complaint", "complaint")
        .when(no_answer, "no_answer")
        .when(verdict == "low_confidence", "low_confidence")
        .when(verdict.isin("fail", "off_topic"), "low_quality")
    )


#: Words that decide an intent, in order, when no model is plugged in.
INTENT_WORDS = {
    "escalation_request": r"(?i)\b(human|agent|supervisor|representative|real person)\b",
    "complaint": r"(?i)\b(complain|complaint|unacceptable|terrible|disappointed|angry)\b",
    "billing": r"(?i)\b(invoice|bill|billing|refund|charge|charged|payment)\b",
    "account": r"(?i)\b(account|login|password|sign in|profile)\b",
    "troubleshooting": r"(?i)\b(error|broken|fails|failed|crash|not working)\b",
    "how_to": r"(?i)\b(how (do|can|to)|steps|guide)\b",
}


def intent_of(text: Column) -> Column:
    """The first intent whose words a message has, else general: the offline default of the classifier."""
    out = F.lit("general")
    for name, pattern in reversed(INTENT_WORDS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def grounding(answer_words: Column, context_words: Column) -> Column:
    """Share of an answer's distinct words that its context has: the offline default of the confidence model."""
    mine = F.array_distinct(answer_words)
    return F.when(F.size(mine) > 0, F.round(F.size(F.array_intersect(mine, context_words)) / F.size(mine), 4)).otherwise(0.0)


def known_intent(intent: Column) -> Column:
    return F.when(intent.isin(*INTENTS), intent).otherwise("general")


def job_state(state: Column, age_seconds: Column, ttl: int = 3600, stuck: int = 1800) -> Column:
    """Finished jobs expire after ttl; running ones count as failed after stuck."""
    done = state.isin("done", "failed")
    return F.when(done & (age_seconds > ttl), "expired").when(~done & (age_seconds > stuck), "failed").otherwise(state)
