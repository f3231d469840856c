"""Ambiguous results: gate, prompt text, response check, overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge.functions import text
from specforge.operators.fallback import comparisons

VALUES = ["price_usd", "weight_g", "drop_mm", "heel_mm", "forefoot_mm"]
RESPONSE_SCHEMA = (
    "mode string, confidence double, resolved boolean, resolved_by string, "
    + ", ".join(f"{v} double" for v in VALUES)
    + ", models array<struct<model_name:string,"
    + ",".join(f"{v}:double" for v in VALUES)
    + ",confidence:double>>, requires_llm_resolution boolean,"
    " resolution_failed_reason string, resolution_notes string")


def gate(df: DataFrame, key: str, has_candidates: Column, max_calls: int | None) -> DataFrame:
    """Add `gate_reason`: null passes, else why a row is held back.

    Rows are taken by key.  The budget (a few hundred calls; None for no limit)
    is used up at the key of the `max_calls`-th passing row, found by a top-k,
    so no window spans the table.
    """
    signal = text.sum_of([F.col(v).isNotNull().cast("int") for v in VALUES]) >= 2
    passing = df.filter(signal & has_candidates)
    over = F.lit(False)
    if max_calls is not None:
        taken = passing.select(key).orderBy(key).limit(max_calls)
        last = taken.agg(F.when(F.count(F.lit(1)) >= max_calls, F.max(key)).alias("k"))
        over = F.coalesce(F.col(key) > last.scalar(), F.lit(max_calls <= 0))
    return df.withColumn("gate_reason", F.when(over, "max_calls_exceeded")
                         .when(~signal, "insufficient_signal")
                         .when(~has_candidates, "no_candidates"))


def mark_gate_skip(df: DataFrame, now: Column) -> DataFrame:
    """Rows held back keep their result under the mode `llm_gate_skipped`."""
    held = F.col("gate_reason").isNotNull()
    return df.withColumns({
        "previous_mode": F.when(held, F.col("mode")),
        "mode": F.when(held, "llm_gate_skipped").otherwise(F.col("mode")),
        "gate_skipped_at": F.when(held, now),
        "method": F.when(held, "llm_gate_skip").otherwise(F.col("method"))})


def clean_line(c: Column) -> Column:
    """Line ends to blanks (letters r and n stay)."""
    return F.trim(F.regexp_replace(c, r"[\r\n]+", " "))


def parse_responses(df: DataFrame, raw: str) -> DataFrame:
    """Typed response in `r`, null with `response_error` when it is unusable."""
    body = F.col(raw)
    unquoted = F.coalesce(F.from_json(F.concat(F.lit("["), body, F.lit("]")),
                                      "array<string>")[0], body)
    parsed = F.from_json(F.when(body.startswith('"'), unquoted).otherwise(body), RESPONSE_SCHEMA)
    df = df.withColumn("_r", parsed)
    r = F.col("_r")
    unit = lambda c: c.between(0, 1)
    multi_ok = F.coalesce(F.forall(r["models"], lambda m: m["model_name"].isNotNull() & (
        m["confidence"].isNull() | unit(m["confidence"]))), F.lit(True))
    valid = F.coalesce(
        F.when(r["mode"] == "resolved", unit(r["confidence"]))
        .when(r["mode"] == "resolved_multi", unit(r["confidence"]) & multi_ok)
        .when(r["mode"] == "ambiguous_multi", r["confidence"].isNull() | unit(r["confidence"])),
        F.lit(False))
    open_ = r["mode"] == "ambiguous_multi"
    tidy = (r.withField("resolved_by", clean_line(r["resolved_by"]))
            .withField("resolution_notes", clean_line(r["resolution_notes"]))
            .withField("models", F.transform(r["models"], lambda m: m.withField(
                "model_name", clean_line(m["model_name"]))))
            .withField("requires_llm_resolution", F.when(open_, True)
                       .otherwise(r["requires_llm_resolution"]))
            .withField("resolution_failed_reason", F.when(open_, F.coalesce(
                F.nullif(r["resolution_failed_reason"], F.lit("")),
                F.lit("llm_returned_ambiguous"))).otherwise(r["resolution_failed_reason"])))
    return df.withColumns({
        "r": F.when(valid, tidy),
        "response_error": F.when(~valid, F.when(r["mode"].isNull(), "invalid_json")
                                 .otherwise("schema_mismatch"))}).drop("_r")


def overlay(prior: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Response fields over the prior result; a bad response marks the failure.

    Rows without a response stay as they are; candidates and telemetry are kept.
    """
    r = responses.select(key, "r", F.col("response_error").alias("_err"),
                         F.lit(True).alias("_has"))
    j = prior.join(r, key, "left")
    ok, bad = F.col("r").isNotNull(), F.col("_has") & F.col("r").isNull()
    new = F.col("r")
    return j.withColumns({
        **{v: F.when(ok, F.coalesce(new[v], F.col(v))).otherwise(F.col(v)) for v in VALUES},
        "mode": F.when(ok, new["mode"]).when(bad, "ambiguous_multi").otherwise(F.col("mode")),
        "models": new["models"],
        "resolution_failed_reason": F.when(ok, new["resolution_failed_reason"])
        .when(bad, F.col("_err")),
        "method": F.when(ok, "llm_resolver").when(bad, "llm_resolver_failure")
        .otherwise(F.col("method"))}).drop("r", "_err", "_has")


# --- context texts ------------------------------------------------------------------

def comparison_context(title: Column, content: Column, max_chars: int | None = None) -> Column:
    """Found comparisons, title and body as one text, cut only if asked to."""
    both = F.concat(title, F.lit("\n\n"), content)
    pairs = F.transform(comparisons(both), lambda p: F.concat(
        p["left"], F.lit(" vs "), p["right"]))
    head = text.let(pairs, lambda found: F.when(F.size(found) > 0, F.concat(
        F.lit("COMPARISONS FOUND: "), F.array_join(found, ", "), F.lit("\n\n"))).otherwise(""))
    full = F.concat(head, both)
    return full if max_chars is None else F.substring(full, 1, max_chars)


def instruction(scenario: Column, brand: Column, model: Column) -> Column:
    named = F.concat_ws(" ", brand, model)
    return (F.when((scenario == "specific") & brand.isNotNull() & model.isNotNull(), F.concat(
        F.lit("Focus on extracting specifications for: "), named))
        .when((scenario == "brand-only") & brand.isNotNull(), F.concat(
            F.lit("Focus on extracting "), brand, F.lit(" models with their specifications")))
        .otherwise("Extract all running shoe models with their specifications"))


def request_text(title: Column, content: Column, scenario: Column, brand: Column,
                 model: Column) -> Column:
    head = F.when(F.coalesce(title, F.lit("")) != "",
                  F.concat(F.lit("Title: "), title, F.lit("\n\n"))).otherwise("")
    return F.concat(head, instruction(scenario, brand, model), F.lit("\n\nContent: "), content)


def candidate_lines(candidates: Column, fields, chars: int | None = None) -> Column:
    """'- field:' and one indented line per snippet, cut with an ellipsis if asked to."""
    def cut(s):
        if chars is None:
            return s
        return F.when(F.length(s) > chars, F.concat(F.substring(s, 1, chars), F.lit("..."))
                      ).otherwise(s)
    parts = [F.when(F.size(candidates[f]) >= 0, F.concat(
        F.lit(f"- {f}:\n"), F.array_join(F.transform(
            candidates[f], lambda s: F.concat(F.lit("  * "), cut(s), F.lit("\n"))), "")))
        for f in fields]
    return F.concat_ws("", *parts)
