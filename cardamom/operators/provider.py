"""Model calls as row functions: prompts, responses, prices, retries, and a deterministic mock of the call itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import longest_prefix
from .scans import asof

# Roles of chat messages, error codes of broken connections.
ROLES = ("system", "user", "assistant", "function")

BROKEN = (
    "ECONNRESET", "ETIMEDOUT", "EAI_AGAIN", "ECONNREFUSED", "EPIPE", "ENETUNREACH", "ENOTFOUND",
    "UND_ERR_SOCKET", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT", "UND_ERR_RESPONSE_EXCEEDED_SIZE",
)

MESSAGE = "struct<role: string, text: string, images: array<struct<mime: string, base64: string>>>"


def role(c: Column) -> Column:
    """A known role, else user."""
    return F.when(c.isin(*ROLES), c).otherwise(F.lit("user"))


def messages(raw: Column) -> Column:
    """The chat messages of a prompt: a JSON array of them, an object with `messages`, or a plain text as one of the user.

    Text parts are joined by a blank line, images are those given as data URLs. Items that are no
    objects, and contents that are neither text nor parts, are left out.
    """
    parsed = F.try_parse_json(raw)
    listed = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.try_variant_get(parsed, "$.messages", "array<variant>"))
    plain = F.array(F.struct(F.lit("user").alias("role"), raw.alias("text"), F.array().cast("array<struct<mime: string, base64: string>>").alias("images")))

    def one(m: Column) -> Column:
        content = F.try_variant_get(m, "$.content", "variant")
        parts = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
        is_parts = F.schema_of_variant(content).startswith("ARRAY")
        texts = F.filter(F.transform(parts, lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string"))), lambda x: x.isNotNull())
        pattern = r"^data:([^;,]+);base64,(.+)$"
        urls = F.filter(F.transform(parts, lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "image_url", F.try_variant_get(p, "$.image_url.url", "string"))), lambda u: F.rlike(u, F.lit(pattern)))
        images = F.transform(urls, lambda u: F.struct(F.regexp_extract(u, pattern, 1).alias("mime"), F.regexp_extract(u, pattern, 2).alias("base64")))
        is_text = F.schema_of_variant(content) == "STRING"
        return F.when(is_text | is_parts, F.struct(role(F.try_variant_get(m, "$.role", "string")).alias("role"), F.when(is_text, F.try_variant_get(content, "$", "string")).otherwise(F.array_join(texts, "\n\n")).alias("text"), images.alias("images")))

    found = F.filter(F.transform(listed, one), lambda m: m.isNotNull())
    return F.when(listed.isNull(), plain).otherwise(found)


def provider_role(c: Column) -> Column:
    """Roles of a provider that knows no functions."""
    return F.when(c == "function", F.lit("system")).otherwise(role(c))


def joined_by_role(turns: DataFrame, by: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """by, system, user: the texts of each role in their order, by blank lines."""

    def texts(r: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col(role) == r, F.struct(order, text))))
        return F.array_join(F.transform(own, lambda x: x[text]), "\n\n").alias(r)

    return turns.groupBy(by).agg(texts("system"), texts("user"))


def ocr_text(pages: Column) -> Column:
    """Text of recognised pages > blocks > lines > words: words by spaces, lines by line ends."""
    lines = F.flatten(F.flatten(F.transform(pages, lambda p: F.transform(p["blocks"], lambda b: b["lines"]))))
    return F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(line["words"], lambda w: w["text"]), " ")), "\n")


def labels(answers: Column) -> Column:
    """Named labels with a finite confidence of nested classifier answers, flat."""
    flat = F.flatten(answers)
    return F.filter(flat, lambda x: (F.coalesce(x["name"], F.lit("")) != "") & x["confidence"].try_cast("double").isNotNull() & ~F.isnan(x["confidence"].try_cast("double")))


def rendered_labels(found: Column, k: int = 3) -> Column:
    """The k most confident labels, as 'name (0.123)'."""
    best = F.slice(F.array_sort(F.transform(found, lambda x: F.struct((-x["confidence"]).alias("order"), x["name"].alias("name")))), 1, k)
    return F.array_join(F.transform(best, lambda x: F.format_string("%s (%.3f)", x["name"], -x["order"])), ", ")


def priced(calls: DataFrame, prices: DataFrame, model: str, rates: list[str], override: dict[str, float] | None = None) -> DataFrame:
    """calls with `price_key` and each rate: the override if it names them all, else the table's with the override's in place, else 0.

    Without an entry in the table, a partial override is filled up with zeros.
    """
    found = longest_prefix(calls, prices, model, "price_key")
    override = override or {}
    return found.select(*calls.columns, "price_key", *[F.coalesce(F.lit(override[r]) if r in override else F.col(r), F.lit(0.0)).alias(r) for r in rates])


def token_cost(prompt: Column, completion: Column, prompt_rate: Column, completion_rate: Column) -> Column:
    """Cost at rates for a thousand tokens."""
    return (prompt * prompt_rate + completion * completion_rate) / 1000


def backoff(attempt: Column, retry_after: Column, jitter: Column, base: int = 1000, most: int = 30_000) -> Column:
    """Milliseconds to wait: what the server asked for (seconds, not negative), else base * 2^attempt * (0.75 + 0.5 * jitter); `most` at most."""
    grown = F.round(F.least(F.lit(base) * F.pow(F.lit(2.0), attempt) * (F.lit(0.75) + 0.5 * jitter), F.lit(float(most))))
    asked = F.least(retry_after * 1000, F.lit(float(most)))
    return F.when(retry_after >= 0, asked).otherwise(grown).cast("long")


def retryable(status: Column, statuses: tuple[int, ...] = (429,), server_errors: bool = True) -> Column:
    """Whether a response is worth another attempt: one of these statuses, or with `server_errors` any 5xx. A null status is not."""
    named = status.isin(list(statuses))
    return F.coalesce(named | ((status >= 500) & (status < 600)) if server_errors else named, F.lit(False))


def broken_connection(code: Column, cause_code: Column, name: Column, message: Column) -> Column:
    """Whether an error is one of the connection: by its own or its cause's code, a failed fetch, an abort or a timeout.

    Nulls are no such sign; a message alone, whatever it says, is not one either.
    """
    signs = (code.isin(list(BROKEN)), cause_code.isin(list(BROKEN)), (name == "TypeError") & F.lower(message).contains("fetch failed"), name.isin("AbortError", "TimeoutError"))
    return F.exists(F.array(*signs), lambda sign: F.coalesce(sign, F.lit(False)))


def retry_after(header: Column) -> Column:
    """Seconds of a Retry-After header: a number that is not negative, else null (a date is none). A blank header is 0."""
    n = F.when(F.trim(header) == "", F.lit(0.0)).otherwise(F.trim(header).try_cast("double"))
    return F.when((n >= 0) & (n < float("inf")) & ~F.isnan(n), n)


def attempts(calls: DataFrame, failures: Column, most: int = 4) -> DataFrame:
    """calls, a row for each attempt: 0 to the first that succeeds, `most` retries at most, with `ok`."""
    n = F.least(failures, F.lit(most)).cast("int")
    return calls.withColumn("attempt", F.explode(F.sequence(F.lit(0), n))).withColumn("ok", F.col("attempt") >= failures)


def live_until(issued: Column, seconds: int, margin: int = 120) -> Column:
    """Until when a cached value serves: its life less a margin."""
    return issued + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds - margin))


def with_tokens(calls: DataFrame, tokens: DataFrame, by: str, at: str, seconds: int, margin: int = 120) -> DataFrame:
    """calls with `issued`: when the newest token (by, issued) that serves the call was issued, null if a new one is due.

    A token serves from its issue until `margin` seconds before its end, so the newest one serves if any does. Calls and
    tokens are put in one order and each token is carried along, over ranges that split an owner of any number
    of calls (see scans.asof). Calls of one owner and time with no token wait for one fetch.
    """
    met = asof(calls, tokens, by, at, "issued", ["issued"])
    return met.withColumn("issued", F.when(F.col(at) < live_until(F.col("issued"), seconds, margin), F.col("issued")))


def file_ids(uploads: DataFrame, cache: DataFrame, content: str, at: str, hours: int = 24) -> DataFrame:
    """uploads with `file_id`: that of the cache entry (content, file_id, uploaded_at) if it is `hours` old at most, else null.

    Of several entries of one content the newest counts.
    """
    newest = cache.groupBy(content).agg(F.max_by(F.struct("file_id", "uploaded_at"), F.struct("uploaded_at", "file_id")).alias("__entry"))
    fresh = F.col(at) <= F.col("__entry.uploaded_at") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return uploads.join(newest, content, "left").withColumn("file_id", F.when(fresh, F.col("__entry.file_id"))).drop("__entry")


def mock_calls(prompts: DataFrame, text: str, price: tuple[float, float] = (0.2, 0.2)) -> DataFrame:
    """prompts with output, error, tokens and cost of a deterministic stand-in for a model.

    A null prompt gives an error in its row instead of a failure of the job. Tokens are four characters each.
    """
    prompt_tokens = F.ceil(F.length(text) / 4)
    output = F.when(F.col(text).isNotNull(), F.to_json(F.struct(F.array().cast("array<string>").alias("violations"), F.lit("approve").alias("verdict"))))
    made = prompts.withColumn("output", output).withColumn("error", F.when(F.col(text).isNull(), F.lit("empty prompt")))
    made = made.withColumn("prompt_tokens", F.coalesce(prompt_tokens, F.lit(0)).cast("long")).withColumn("completion_tokens", F.coalesce(F.ceil(F.length("output") / 4), F.lit(0)).cast("long"))
    return made.withColumn("cost", token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.lit(price[0]), F.lit(price[1])))
