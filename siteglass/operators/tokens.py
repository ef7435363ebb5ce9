"""Token estimates, cost, budgets, prepared content and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import round_half_up
from .ordered import running_before

# --- fixed values: USD per token, by model -------------------------------------------
PRICES = {
    "gpt-4": {"input": 0.03 / 1000, "output": 0.06 / 1000},
    "gpt-4-turbo": {"input": 0.01 / 1000, "output": 0.03 / 1000},
    "gpt-3.5-turbo": {"input": 0.0005 / 1000, "output": 0.0015 / 1000},
}
DEFAULT_MODEL = "gpt-4"
MESSAGE_OVERHEAD = 10
SUMMARY_THRESHOLD = 1000
CHUNK_TOKENS = 2000
# ------------------------------------------------------------------------------------------


def token_count(text: Column) -> Column:
    """Estimate: a token per four characters, rounded up; no text has none."""
    return F.coalesce(F.ceil(F.length(text) / 4.0).cast("int"), F.lit(0))


def message_tokens(messages: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """Estimated tokens per conversation, message overhead included."""
    return messages.groupBy(key).agg(
        F.sum(token_count(F.col(text)) + MESSAGE_OVERHEAD).alias("tokens"), F.count("*").alias("messages")
    )


def cost(tokens: Column, model: Column | str = DEFAULT_MODEL, operation: Column | str = "input") -> Column:
    """Estimated USD; an unknown model is priced as gpt-4, an unknown operation as input."""
    name = F.lit(model) if isinstance(model, str) else model
    way = F.lit(operation) if isinstance(operation, str) else operation

    def rate(kind: str) -> Column:
        out = F.lit(PRICES[DEFAULT_MODEL][kind])
        for m, p in PRICES.items():
            out = F.when(name == m, F.lit(p[kind])).otherwise(out)
        return out

    return tokens * F.when(way == "output", rate("output")).otherwise(rate("input"))


def has_limit(limit: Column) -> Column:
    return F.coalesce(limit > 0, F.lit(False))


def within_budget(current: Column, additional: Column, limit: Column) -> Column:
    return ~has_limit(limit) | (current + additional <= limit)


def remaining(current: Column, limit: Column) -> Column:
    """Tokens left, never negative; infinite without a limit."""
    return F.when(has_limit(limit), F.greatest(F.lit(0), limit - current).cast("double")).otherwise(F.lit(float("inf")))


def token_stats(usage: DataFrame, total: str = "total_tokens", limit: str = "token_limit", model: str = DEFAULT_MODEL) -> DataFrame:
    """Cost, and where there is a limit: percent used, remaining, exceeded."""
    t, cap = F.col(total), F.col(limit)
    limited = F.coalesce(cap != 0, F.lit(False))
    return usage.withColumns({
        "limited_mode": limited,
        "cost_usd": cost(t, model),
        "percent_used": F.when(limited, round_half_up(t / cap * 100)),
        "remaining_tokens": F.when(limited, remaining(t, cap)),
        "exceeded": F.when(limited, t > cap),
    })


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    return F.coalesce(F.substring(text, 1, tokens * 4), F.lit(""))


def needs_summary(text: Column, threshold: int = SUMMARY_THRESHOLD) -> Column:
    return token_count(text) > threshold


def budget_cut(items: DataFrame, run: str, bucket: Column, order: list[Column], tokens: str, limit: Column) -> DataFrame:
    """Items processed before the budget is used up: the sum *before* an item must be below the limit,
    so the last item may overshoot. No limit (null or 0) keeps everything. Hot runs are bucketed."""
    used = running_before(items, [run], bucket, order, F.col(tokens), "tokens_before")
    return used.filter(~F.coalesce(limit != 0, F.lit(False)) | (F.col("tokens_before") < limit))


def structured_info(extraction: DataFrame) -> Column:
    """Compact struct of an extraction row (columns of ``extraction.extract``)."""
    return F.struct(
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("meta_description", F.lit("")).alias("meta_description"),
        F.slice("headings", 1, 10).alias("headings"),
        F.size("faq").alias("faq_count"),
        F.slice("faq", 1, 3).alias("faq_sample"),
        F.size("internal_links").alias("internal_links"),
        F.size("outbound_links").alias("outbound_links"),
        F.col("schema_types"),
        F.col("author"),
        F.col("date_published"),
        F.coalesce("metrics.word_count", F.lit(0)).alias("word_count"),
        (F.coalesce("canonical_url", F.lit("")) != "").alias("has_canonical"),
    )


def context_text(info: Column) -> Column:
    """Short description of a page; lines without content are left out."""
    headings = F.array_join(
        F.transform(info["headings"], lambda h: F.concat(h["text"], F.lit(" (H"), h["level"].cast("string"), F.lit(")"))), ", "
    )
    return F.concat_ws(
        "\n",
        F.when(info["title"] != "", F.concat(F.lit("Title: "), info["title"])),
        F.when(info["meta_description"] != "", F.concat(F.lit("Meta: "), info["meta_description"])),
        F.when(F.size(info["headings"]) > 0, F.concat(F.lit("Headings: "), headings)),
        F.when(F.size(info["faq_sample"]) > 0, F.concat(F.lit("FAQs: "), F.array_join(F.transform(info["faq_sample"], lambda f: f["question"]), "; "))),
        F.when(F.size(info["schema_types"]) > 0, F.concat(F.lit("Schema: "), F.array_join(info["schema_types"], ", "))),
        F.concat(F.lit("Links: "), info["internal_links"].cast("string"), F.lit(" internal, "), info["outbound_links"].cast("string"), F.lit(" external")),
        F.concat(F.lit("Words: "), info["word_count"].cast("string")),
    )


def prepare_content(extraction: DataFrame, text: str = "body", summary: str | None = None, threshold: int = SUMMARY_THRESHOLD, force: bool = False) -> DataFrame:
    """Content for an outside scorer.

    Short pages carry their text (``structured-only``). Long ones carry the summary column when
    there is one (``ai-summarized``), else they are flagged ``needs-summary`` with no content.
    """
    rows = extraction.withColumn("context", context_text(structured_info(extraction)))
    body = F.coalesce(F.col(text), F.lit(""))
    short = F.lit(False) if force else ~needs_summary(body, threshold)
    brief = F.lit(None).cast("string") if summary is None else F.col(summary)
    content = F.when(short, F.concat(F.col("context"), F.lit("\n\nMain Content:\n"), body)).when(
        brief.isNotNull(), F.concat(F.col("context"), F.lit("\n\nContent Summary:\n"), brief)
    )
    original, final = token_count(body), token_count(brief)
    reduction = round_half_up((original - final) / F.when(original > 0, original) * 100)
    rows = rows.withColumns({
        "content": content,
        "method": F.when(short, "structured-only").when(brief.isNotNull(), "ai-summarized").otherwise("needs-summary"),
        "original_tokens": original,
        "savings_percent": F.when(~short & brief.isNotNull(), reduction).otherwise(F.lit(0)),
        "savings_tokens": F.when(~short & brief.isNotNull(), original - final).otherwise(F.lit(0)),
    })
    return rows.withColumn("token_count", token_count(F.col("content")))


def chunks(text: Column, limit: int = CHUNK_TOKENS) -> Column:
    """Greedy paragraph chunks: array<struct<text, tokens>>; ``tokens`` is the sum over its paragraphs.

    A paragraph starts a new chunk when it would pass the limit and the current chunk is not empty.
    """
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        size = token_count(p)
        started = F.exists(acc["cur"], lambda x: x != "")
        full = started & (acc["n"] + size > limit)
        grown = F.when(started, F.concat(acc["cur"], F.array(p))).otherwise(F.array(p))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(grown).alias("cur"),
            F.when(full, size).otherwise(acc["n"] + size).alias("n"),
        )

    def finish(acc: Column) -> Column:
        groups = F.concat(acc["done"], F.array(acc["cur"]))
        joined = F.transform(groups, lambda g: F.array_join(g, "\n\n"))
        return F.filter(joined, lambda t: t != "")

    return F.aggregate(F.split(text, "\n\n+"), empty, step, finish)


def parse_json_reply(text: Column) -> Column:
    """VARIANT of a reply that may be wrapped in a fenced block; null where it does not parse."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?i)```json?\s*\n?", ""), r"\n?```\s*$", "")
    return F.try_parse_json(bare)


def clamp_scores(scores: Column) -> Column:
    """map<string,string> -> map<string,int> limited to 0-100; what is no number becomes null."""

    def one(_: Column, v: Column) -> Column:
        number = F.regexp_extract(v, r"^\s*([+-]?[0-9]+)", 1)
        parsed = F.when(number != "", F.least(F.lit(100), F.greatest(F.lit(0), F.expr("0") + number.try_cast("int"))))
        return F.when(number.try_cast("int").isNotNull(), parsed)

    return F.transform_values(scores, one)
