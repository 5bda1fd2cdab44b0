"""Scalar functions of usage counters, names, dates and text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.profile import Profile

#: Authority ranks, weakest first.
AUTHORITY = ("estimated", "reconstructed", "tool", "provider")
#: Largest counter that is accepted.
SAFE = 2**53 - 1


def day_of(ts: Column, p: Profile) -> Column:
    """Calendar day of a UTC instant in the profile's zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), p.timezone))


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def headline_inclusive(i: Column, c: Column, o: Column) -> Column:
    """Tokens where cached input is counted inside input."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(i, F.lit(0)) - F.coalesce(c, F.lit(0))) + F.coalesce(o, F.lit(0))


def headline_exclusive(i: Column, w: Column, o: Column) -> Column:
    """Tokens where the cache is counted outside input: input, cache writes and output."""
    return F.coalesce(i, F.lit(0)) + F.coalesce(w, F.lit(0)) + F.coalesce(o, F.lit(0))


def table_tokens(i: Column, o: Column, total: Column, reads: Column, convention: str | None) -> Column:
    """Tokens of a ledger-table row; null if the convention leaves it undecided."""
    cached = F.coalesce(reads, F.lit(0)) > 0
    plain = F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0))
    known = {"inclusive": headline_inclusive(i, reads, o), "exclusive": plain}.get(convention or "", F.lit(None).cast("bigint"))
    return F.when(i.isNull() & o.isNull(), F.when(~cached, total)).when(cached, known).otherwise(plain)


def task_tokens(i: Column, o: Column, w: Column, r: Column, convention: str | None) -> Column:
    """Tokens of a task message, its counting convention told from its own counters where possible."""
    legacy, inclusive = i + w + o, F.greatest(F.lit(0).cast("bigint"), i - r) + o
    given = {"inclusive": inclusive, "legacy": legacy}.get(convention or "", F.lit(None).cast("bigint"))
    return F.when((w == 0) & (r == 0), i + o).when(i < r + w, legacy).otherwise(given)


def response_tokens(prompt: Column, completion: Column, total: Column) -> tuple[Column, Column]:
    """Tokens of a captured response, and whether its total contradicts its parts."""
    parts = prompt + completion
    return F.greatest(parts, F.coalesce(total, parts)), F.coalesce(total < parts, F.lit(False))


# How a local model's name begins, and the source of its family; and the providers that run models locally.
FAMILIES = (("qwen", "qwen_local"), ("gemma", "gemma_local"), ("llama", "llama_local"), ("deepseek", "deepseek_local"), ("gpt[-_]?oss", "gpt_oss"))
LOCAL_PROVIDERS = ("ollama", "lmstudio", "mlx", "llamacpp")


def local_source(model: Column, provider: Column) -> Column:
    """Source of a local model: its family's, else its own name with ``_local``; of an unknown provider the provider's id."""
    own = F.when(F.lower(provider).isin(*LOCAL_PROVIDERS), F.concat(slug(model, "_"), F.lit("_local"))).otherwise(F.coalesce(slug(provider, "_"), slug(model, "_")))
    for pattern, source in reversed(FAMILIES):
        own = F.when(F.lower(model).rlike(f"^{pattern}"), source).otherwise(own)
    return own


def source_of(model: Column, provider: Column, prefix: str = "hosted_") -> Column:
    """Local models by family or name, hosted ones by provider; without a provider a model is local."""
    named = F.coalesce(F.nullif(provider, F.lit("")), F.lit(LOCAL_PROVIDERS[0]))
    return F.when(F.lower(named).isin(*LOCAL_PROVIDERS), local_source(model, named)).otherwise(F.concat(F.lit(prefix), slug(named, "_")))


# The whole names of saved configurations, and the model each stands for.
CONFIG_MODELS = {
    "opus 4.6": "claude-opus-4-6", "anthropic - opus 4.6": "claude-opus-4-6", "claude opus 4.6": "claude-opus-4-6",
    "opus 4.5": "claude-opus-4-5", "anthropic - opus 4.5": "claude-opus-4-5", "claude opus 4.5": "claude-opus-4-5",
    "sonnet 4.6": "claude-sonnet-4-6", "anthropic - sonnet 4.6": "claude-sonnet-4-6", "claude sonnet 4.6": "claude-sonnet-4-6",
    "sonnet 4.5": "claude-sonnet-4-5", "anthropic - sonnet 4.5": "claude-sonnet-4-5", "claude sonnet 4.5": "claude-sonnet-4-5",
    "gemini 3.1 pro preview": "gemini-3.1-pro-preview", "gemini 3": "gemini-3-pro-preview", "gemini 3 pro preview": "gemini-3-pro-preview",
    "gemini flash": "gemini-3-flash-preview",
}


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """The value of ``table`` for a key; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def model_of_config(name: Column) -> Column:
    """Model that a configuration's whole name stands for; an unknown name gives null, not a guess."""
    return looked_up(F.lower(F.trim(name)), CONFIG_MODELS)


def compatible_tokens(prompt: Column, completion: Column, nested: Column, flat: Column) -> Column:
    """Tokens of a compatible response: cached input, told nested or else flat, is taken off the prompt.

    Null if a counter is missing or more is cached than was asked.
    """
    cached = F.coalesce(nested, flat, F.lit(0))
    return F.when(cached <= prompt, prompt - cached + completion)


def cache_writes(broken_down: Column, flat: Column) -> tuple[Column, Column]:
    """Cache writes, summed from a map if there is one, else flat, else 0; and whether any were reported."""
    zero = F.lit(0).cast("bigint")
    total = F.aggregate(F.map_values(broken_down), zero, lambda a, x: a + F.coalesce(x, zero))
    return F.coalesce(total, flat, zero), broken_down.isNotNull() | flat.isNotNull()


def slug(text: Column, joiner: str = "-") -> Column:
    """Lower-case letters and digits, other runs as one joiner, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")


def origin_kind(origin: Column) -> Column:
    """account for ``account/...``, unattributed for null or that word, and machine for everything else."""
    return F.when(origin.startswith("account/"), "account").when(F.coalesce(origin, F.lit("unattributed")) == "unattributed", "unattributed").otherwise("machine")


def origin_parts(origin: Column) -> Column:
    """kind, machine and profile of an origin ``machine/profile``; an account has neither, a bare machine no profile."""
    kind, parts = origin_kind(origin), F.split(origin, "/")
    machine, profile = F.get(parts, F.lit(0)), F.nullif(F.get(parts, F.lit(1)), F.lit(""))
    return F.struct(kind.alias("kind"), F.when(kind == "machine", machine).alias("machine"), F.when(kind == "machine", profile).alias("profile"))


def is_calendar_date(text: Column) -> Column:
    """True for YYYY-MM-DD text that names a real day."""
    shape = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.coalesce(shape & F.try_to_date(F.when(shape, text), "yyyy-MM-dd").isNotNull(), F.lit(False))


def to_instant(number: Column) -> Column:
    """Seconds or milliseconds since the epoch as a timestamp."""
    return F.when(number > 1e10, F.timestamp_millis(number.cast("bigint"))).otherwise(F.timestamp_seconds(number))


def any_instant(text: Column) -> Column:
    """A timestamp from text: seconds or milliseconds since the epoch, or a date with or without a time; null for others."""
    number = F.try_to_number(F.when(text.rlike(r"^[0-9]{1,15}(\.[0-9]{1,6})?$"), text), F.lit("999999999999999.999999")).cast("double")
    return F.when(number.isNotNull(), to_instant(number)).otherwise(F.try_to_timestamp(text))


def request_key(text: Column) -> Column:
    """One-way key of a request identity."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def js_round(x: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x + 0.5)


def format_tokens(n: Column) -> Column:
    """1.2M from a million on, 3K from a thousand on, else the plain number; halves go up."""
    tenths = js_round(n * 10 / 1_000_000).cast("bigint")
    million = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("M"))
    return F.when(n >= 1_000_000, million).when(n >= 1_000, F.concat(js_round(n / 1_000).cast("bigint").cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def share_text(value: Column, total: Column) -> Column:
    """A share in per cent as text: 0%, <1%, or rounded."""
    percent = 100.0 * value / F.nullif(total, F.lit(0))
    return F.when(percent.isNull() | (percent == 0), "0%").when(percent < 1, "<1%").otherwise(F.concat(js_round(percent).cast("bigint").cast("string"), F.lit("%")))


def delta_percent(now: Column, before: Column) -> Column:
    """Rounded change in per cent; null if either is missing or the earlier one is zero."""
    return js_round(100.0 * (now - before) / F.nullif(before, F.lit(0))).cast("bigint")


# Labels of known sources.
SOURCE_LABELS = {
    "chatgpt": "ChatGPT", "claude_api": "Claude API", "claude_chat": "Claude Chat", "claude_code": "Claude Code", "claude_cowork": "Claude Cowork", "claude_design": "Claude Design", "cline": "Cline", "codex": "Codex",
    "copilot_cli": "Copilot CLI", "cursor": "Cursor", "deepseek_api": "DeepSeek API", "deepseek_local": "DeepSeek local", "gemini": "Gemini", "gemini_cli": "Gemini CLI", "gemma_local": "Gemma local", "gpt_oss": "GPT-OSS", "grok": "Grok",
    "groq_api": "Groq API", "kilo": "Kilo Code", "llama_local": "Llama local", "local_deepseek": "DeepSeek local", "local_gemma": "Gemma local", "local_llama": "Llama local", "local_qwen": "Qwen local", "mistral_api": "Mistral API",
    "openai_api": "OpenAI API", "openrouter_api": "OpenRouter API", "perplexity": "Perplexity", "perplexity_api": "Perplexity API", "perplexity_chat": "Perplexity Chat", "qwen_code": "Qwen Code", "qwen_local": "Qwen local",
    "roo_code": "Roo Code", "snapdev": "Snapdev", "together_api": "Together API", "typesafe_api": "TypeSafe API", "xai_api": "xAI API", "zed_agent": "Zed agent",
}


def source_label(source: Column) -> Column:
    """The label of a known source, else its id with each part's first letter in upper case."""
    first = lambda part: F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 1 << 20))
    return F.coalesce(looked_up(source, SOURCE_LABELS), F.array_join(F.transform(F.split(source, "_"), first), " "))


def authority_rank(authority: Column) -> Column:
    """1 (estimated) to 4 (provider); null if missing."""
    out = F.lit(None).cast("int")
    for i, a in enumerate(AUTHORITY, 1):
        out = F.when(authority == a, i).otherwise(out)
    return out


def authority_name(rank: Column) -> Column:
    """The authority of a rank."""
    out = F.lit(None).cast("string")
    for i, a in enumerate(AUTHORITY, 1):
        out = F.when(rank == i, a).otherwise(out)
    return out


def sum_if_complete(c: Column) -> Column:
    """Sum, but null unless every contributor has the value."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def weakest_authority(authority: Column) -> Column:
    """The weakest authority; null unless every contributor has one."""
    rank = authority_rank(authority)
    return authority_name(F.when(F.count(rank) == F.count(F.lit(1)), F.min(rank)))
