"""Row-wise operators: filters, classifications and masks (inventory P).

Every function takes a DataFrame or columns and adds or filters rows with built-in
expressions only, so that they push down to the scan and stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Evidence classes that ground a claim, from strongest.
GROUNDED = ("A", "B", "C")
#: Parts of a key that make its value sensitive, and keys that are safe.
SENSITIVE = ("token", "secret", "password", "authorization", "cookie", "api_key", "apikey", "transcript", "text", "prompt")
SAFE = ("input_tokens", "output_tokens", "cached_tokens", "total_tokens", "token_count")
#: Keys of log records that are never redacted, and parts of keys that always are.
LOG_SAFE = tuple(
    """request_id job_id recording_id book_id chapter_number family_id trace_id worker_id attempt status_code duration_ms method route
    service environment level timestamp logger backend size_bytes mime_type content_type content-type content_length content-length
    user-agent host accept provider model operation error_code exception_class event retryable poll_interval_seconds lease_seconds
    heartbeat_seconds chapters_total chapters_approved word_count target_word_count output_language stage format export_format
    plan_version repair_attempts status""".split()
)
LOG_SENSITIVE = tuple(
    """authorization cookie set-cookie token access_token refresh_token password secret api_key service_role_key signed_url transcript
    prompt response_content story_content body audio_bytes email first_name last_name speaker_name story quote text content prose
    draft_text final_text evidence_quote unresolved_question""".split()
)
#: Parts of keys that traces leave out.
TRACE_SENSITIVE = ("api_key", "audio_path", "authorization", "body", "name", "prompt", "secret", "text", "token", "transcript")
#: What tokens in the strings of log records look like, and what stands for them.
LOG_TOKENS = ((r"(?i)Bearer\s+[A-Za-z0-9-_=.]+", "Bearer [REDACTED]"), (r"\beyJ[A-Za-z0-9-_]+\.eyJ[A-Za-z0-9-_]+\.[A-Za-z0-9-_]+\b", "[REDACTED_TOKEN]"))


def present(c: Column | str) -> Column:
    """Neither null nor blank."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c) != "")


def family_scope(df: DataFrame, family_id, column: str = "family_id") -> DataFrame:
    """The rows of one family, by a predicate that reaches the scan."""
    return df.where(F.col(column) == F.lit(family_id))


def grounded_claims(df: DataFrame) -> DataFrame:
    """Claims with a subject, a grounding class and some evidence."""
    return df.where(
        F.col("subject_person_id").isNotNull() & F.col("evidence_class").isin(*GROUNDED) & (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0)
    )


def grounded_relationships(df: DataFrame) -> DataFrame:
    """Grounded claims between two different people that are active."""
    ends = F.col("object_person_id").isNotNull() & (F.col("subject_person_id") != F.col("object_person_id"))
    return grounded_claims(df).where(ends & (F.col("status") == "active"))


def relationship_status(df: DataFrame, out: str = "status") -> DataFrame:
    """The first rule that holds names the status."""
    state = F.col("state")
    return df.withColumn(
        out,
        F.when(F.col("subject_person_id").isNull() | F.col("object_person_id").isNull(), "unresolved")
        .when(F.col("uncertain"), "unresolved")
        .when(state == "former", "historical")
        .when(state == "ended", "ended")
        .when(state == "negated", "negated")
        .when(state == "figurative", "figurative")
        .when(F.coalesce(state, F.lit("")) != "current", "unresolved")
        .otherwise("active"),
    )


def truth_eligible(claims: DataFrame, selected: DataFrame, allow_disputed: bool = False) -> DataFrame:
    """P5: claims of selected recordings that a text may state as true."""
    statuses = ["active", "accepted"] + (["disputed"] if allow_disputed else [])
    sound = F.col("status").isin(*statuses) & (F.coalesce(F.col("verification"), F.lit("")) != "rejected")
    sound = sound & (F.col("assertion_mode").isNull() | (F.col("assertion_mode") == "explicit"))
    sound = sound & F.upper("evidence_class").isin(*GROUNDED) & (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0)
    kind = F.col("object_type")
    sound = sound & (kind != "unresolved_question") & ((kind != "person_mention") | F.col("subject_person_id").isNotNull())
    sound = sound & ((kind != "relationship") | ((F.col("state") == "current") & ~F.col("uncertain") & F.col("object_person_id").isNotNull()))
    return claims.where(sound).join(selected.select("recording_id").distinct(), "recording_id", "left_semi")


def uncertainty_eligible(claims: DataFrame, selected: DataFrame) -> DataFrame:
    """Open questions of selected recordings, not rejected, with evidence."""
    sound = (F.col("object_type") == "unresolved_question") & (F.col("status") == "open")
    sound = sound & (F.coalesce(F.col("verification"), F.lit("")) != "rejected") & (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0)
    return claims.where(sound).join(selected.select("recording_id").distinct(), "recording_id", "left_semi")


def date_view(df: DataFrame, normalized: str = "normalized_value", value: str = "value", precision: str = "precision", approximate: str = "approximate") -> DataFrame:
    """The value to show of an imprecise date."""
    return df.withColumn("date_value", F.coalesce(normalized, value)).withColumn("date_precision", F.coalesce(F.col(precision), F.lit("unknown"))).withColumn(
        "date_approximate", F.coalesce(F.col(approximate), F.lit(False))
    )


def excerpt(text: Column | str, most: int = 280) -> Column:
    """White space collapsed; a longer text is cut, trimmed and gets an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds with their fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def retry_state(jobs: DataFrame, now: Column, waiting: str = "waiting_for_asr") -> DataFrame:
    """Whether a job may be retried, and in how many whole seconds."""
    retryable = (F.col("status") == "queued") & (F.col("stage") == waiting)
    wait = F.ceil(F.greatest(F.lit(0.0), seconds_between(F.col("next_attempt_at"), now))).cast("long")
    return jobs.withColumn("retryable", retryable).withColumn("retry_in_seconds", F.when(retryable, F.coalesce(wait, F.lit(0).cast("long"))))


def safe_key(key: Column | str) -> Column:
    """P10: whether a storage key has no blank, ``.`` or ``..`` segment, once
    backslashes are slashes and outer slashes are off."""
    key = F.col(key) if isinstance(key, str) else key
    flat = F.regexp_replace(F.replace(F.trim(key), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.coalesce((flat != "") & ~F.exists(F.split(flat, "/"), lambda s: F.trim(s).isin("", ".", "..")), F.lit(False))


def masked_text(text: Column | str) -> Column:
    """Bearer and web tokens of a string masked."""
    out = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    return F.regexp_replace(out, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[redacted]")


def is_sensitive(key: Column, sensitive: Sequence[str] = SENSITIVE, safe: Sequence[str] = SAFE) -> Column:
    low = F.lower(key)
    some = F.lit(False)
    for part in sensitive:
        some = some | low.contains(part)
    return some & ~low.isin(*safe) if safe else some


def redact_map(df: DataFrame, col: str) -> DataFrame:
    """Values under sensitive keys replaced, tokens masked in all others."""
    return df.withColumn(col, F.transform_values(col, lambda k, v: F.when(is_sensitive(k), F.lit("[redacted]")).otherwise(masked_text(v))))


def redact_log_map(df: DataFrame, col: str) -> DataFrame:
    """P11 by the rules of log records: values whose trimmed key has a sensitive part,
    unless it is a safe key, become [REDACTED]; tokens in all others are masked."""

    def value(k: Column, v: Column) -> Column:
        for pattern, mark in LOG_TOKENS:
            v = F.regexp_replace(v, pattern, mark)
        return F.when(is_sensitive(F.trim(k), LOG_SENSITIVE, LOG_SAFE), F.lit("[REDACTED]")).otherwise(v)

    return df.withColumn(col, F.transform_values(col, value))


def trace_attributes(df: DataFrame, col: str, most: int = 256, sensitive: Sequence[str] = SENSITIVE, safe: Sequence[str] = SAFE) -> DataFrame:
    """Keys trimmed, lower-cased and cut at 64; empty and sensitive ones drop;
    values cut. Keys that become equal keep the last value."""
    entries = F.transform(F.map_entries(col), lambda e: F.struct(F.substring(F.lower(F.trim(e.key)), 1, 64).alias("key"), F.substring(e.value, 1, most).alias("value")))
    kept = F.filter(entries, lambda e: (e.key != "") & ~is_sensitive(e.key, sensitive, safe) & e.value.isNotNull())
    keys = F.array_distinct(F.transform(kept, lambda e: e.key))
    last = F.transform(keys, lambda k: F.element_at(F.transform(F.filter(kept, lambda e: e.key == k), lambda e: e.value), -1))
    return df.withColumn(col, F.map_from_arrays(keys, last))


def opaque(id_: Column | str) -> Column:
    """An id that can't be traced back by reading."""
    return F.concat(F.lit("object_"), F.substring(F.sha2(F.col(id_) if isinstance(id_, str) else id_, 256), 1, 16))


def opaque_ids(df: DataFrame, id_col: str, related_col: str, detail_col: str) -> DataFrame:
    """Ids and related ids hashed, details dropped."""
    return df.withColumn(id_col, opaque(id_col)).withColumn(related_col, F.transform(related_col, opaque)).drop(detail_col)


def stable_id(prefix: str, *parts: Column, length: int = 32) -> Column:
    """A deterministic id of parts; a null part counts as empty."""
    joined = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, length))


def ai_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost of each event from a table of rates a million tokens (and a second
    of audio). Unknown models, and events to which no rate applies, cost null."""
    name = lambda c: F.lower(F.trim(F.col(c)))
    keyed = rates.select(
        name("provider").alias("_p"), name("model").alias("_m"),
        *[F.col(c).cast("decimal(12,6)").alias(f"_{c}") for c in ("input_rate", "cached_rate", "output_rate", "audio_rate")],
    )
    cached = F.least(F.coalesce("cached_tokens", F.lit(0)), F.coalesce("input_tokens", F.lit(0)))
    missed = F.coalesce("input_tokens", F.lit(0)) - cached
    tokens = missed * F.col("_input_rate") + cached * F.coalesce("_cached_rate", "_input_rate") + F.coalesce("output_tokens", F.lit(0)) * F.col("_output_rate")
    audio = F.col("audio_seconds") * F.col("_audio_rate")
    has_tokens = F.col("_input_rate").isNotNull() & (F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull())
    total = F.when(has_tokens, tokens.cast("decimal(24,6)") * F.lit(Decimal("0.000001")))
    cost = F.when(total.isNotNull() | audio.isNotNull(), F.coalesce(total, F.lit(0)) + F.coalesce(audio, F.lit(0)))
    joined = usage.join(keyed, (name("provider") == F.col("_p")) & (name("model") == F.col("_m")), "left")
    return joined.select(*usage.columns, F.round(cost.cast("decimal(24,12)"), 6).cast("decimal(18,6)").alias("cost"))


def retry_schedule(failures: DataFrame, rules: DataFrame, base: float = 2.0, most: float = 300.0) -> DataFrame:
    """Category and disposition by rule; the delay doubles with each attempt up
    to a bound, a server's own delay overrides it, and half a second is the least."""
    joined = failures.join(rules, "error_code", "left")
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(most))
    delay = F.greatest(F.coalesce(F.col("retry_after"), delay), F.lit(0.5))
    return joined.select(
        *failures.columns, F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("disposition", F.lit("fail")).alias("disposition"),
        F.when(F.col("disposition") == "retry", delay).alias("delay_seconds"),
    )


def story_people(stories: DataFrame, people: DataFrame, n: int, keys: Sequence[str] = ("story_id",), ids: str = "person_ids") -> DataFrame:
    """The story's known people in order: the first n, and how many more."""
    one = stories.select(*keys, F.posexplode(ids).alias("pos", "person_id")).join(people.select("person_id").distinct(), "person_id", "left_semi")
    known = one.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "person_id"))), lambda x: x.person_id).alias("known"))
    none = F.array().cast("array<string>") if dict(people.dtypes)["person_id"] == "string" else F.array().cast("array<bigint>")
    both = stories.select(*keys).join(known, list(keys), "left").withColumn("known", F.coalesce("known", none))
    return both.select(*keys, F.slice("known", 1, n).alias("shown"), F.greatest(F.size("known") - n, F.lit(0)).cast("long").alias("hidden"))


def result_summary(results: DataFrame) -> DataFrame:
    """One row per result from its nested payload: first story, people without
    the narrator's own mentions, distinct places, and whether it needs review."""
    first = F.get("stories", F.lit(0))
    people = F.filter("people", lambda p: ~F.coalesce(p.is_narrator, F.lit(False)))
    open_ = F.exists("people", lambda p: p.resolution.isin("ambiguous", "unresolved"))
    review = (F.size("questions") > 0) | (F.size("conflicts") > 0) | open_
    return results.select(
        "recording_id", first.title.alias("title"), first.summary.alias("summary"),
        F.size(people).cast("long").alias("n_people"),
        F.array_distinct(F.filter(F.transform("events", lambda e: e.location), lambda x: x.isNotNull())).alias("places"),
        F.coalesce(review, F.lit(False)).alias("needs_review"),
        (present(first.title) | present(first.summary)).alias("presentable"),
    )
