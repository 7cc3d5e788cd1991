"""Text column functions: cleaning, keys, templates, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.rules import BRAND, Brand, LIMITS

# Letters, digits and underscore of any script, and whitespace of any script; spelled out
# so that Java and RE2 agree.
WORD = r"[\p{L}\p{N}_]"
SPACES = r"\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}"
SPACE = rf"[{SPACES}]"
HANDLE = rf"@{WORD}+"
URL = rf"https?://[^{SPACES}]+"
PLACEHOLDERS = r"\{customer_handle\}|\{dm_link\}|\{help_link\}"


def strip(text: Column) -> Column:
    """Trim any leading and trailing whitespace, not only spaces."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def contains_any(lowered: Column, words: tuple[str, ...] | list[str]) -> Column:
    """True if the (already lower-cased) text holds one of the substrings."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(lowered, F.lit(word))
    return hit


def clean_message(text: Column) -> Column:
    """Message without links, then without handles, whitespace collapsed."""
    return squeeze(F.regexp_replace(F.regexp_replace(text, URL, ""), HANDLE, ""))


def sanitize_customer(text: Column) -> Column:
    """Customer side of a pair: handles go first, then links."""
    return squeeze(F.regexp_replace(F.regexp_replace(text, HANDLE, ""), URL, ""))


def sanitize_reply(text: Column, brand: Brand = BRAND) -> Column:
    """Agent side of a pair with handles and links turned into placeholders.

    A link becomes ``{dm_link}`` when the reply speaks of direct messages anywhere.
    """
    body = F.regexp_replace(strip(text), rf"^{HANDLE}{SPACE}*", "{customer_handle} ")
    body = F.regexp_replace(body, rf"{brand.tag}(?!{WORD})", "")
    body = F.regexp_replace(body, HANDLE, "{customer_handle}")
    private = contains_any(F.lower(body), ("dm", "direct message"))
    linked = F.when(private, F.regexp_replace(body, URL, "{dm_link}")).otherwise(
        F.regexp_replace(body, URL, "{help_link}")
    )
    return squeeze(linked)


def dedup_key(text: Column) -> Column:
    """Key under which two texts count as the same wording."""
    bare = F.regexp_replace(F.lower(text), PLACEHOLDERS, "")
    return squeeze(F.regexp_replace(bare, rf"[^\p{{L}}\p{{N}}_{SPACES}]", ""))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the lower-cased text with whitespace collapsed."""
    return F.sha2(squeeze(F.lower(text)), 256)


def case_key(case_id: Column, text: Column) -> Column:
    """Key of one case and text: id plus 16 hex digits of the text's hash."""
    return F.concat_ws("_", case_id.cast("string"), F.substring(F.sha2(text, 256), 1, 16))


def parse_created_at(value: Column, fallback: Column | None = None) -> Column:
    """Timestamp of ``Tue Oct 31 22:10:47 +0000 2017``; otherwise ``fallback`` (NULL)."""
    shaped = F.regexp_extract(strip(value), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (.+)$", 1)
    parsed = F.try_to_timestamp(
        F.when(shaped != "", shaped), F.lit("MMM d HH:mm:ss Z yyyy")
    )
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def at_handle(handle: Column) -> Column:
    """Handle with its leading ``@``."""
    return F.when(handle.startswith("@"), handle).otherwise(F.concat(F.lit("@"), handle))


def put_placeholders(text: Column, handle: Column, brand: Brand = BRAND) -> Column:
    """Literal replacement of the three placeholders."""
    text = F.replace(text, F.lit("{customer_handle}"), handle)
    text = F.replace(text, F.lit("{dm_link}"), F.lit(brand.dm_link))
    return F.replace(text, F.lit("{help_link}"), F.lit(brand.help_link))


def fill_template(
    template: Column, handle: Column, brand: Brand = BRAND, limit: int = LIMITS.reply_chars
) -> Column:
    """Reply from a stored template: placeholders, handle in front, cut to the limit."""
    filled = put_placeholders(template, handle, brand)
    addressed = F.when(filled.startswith(handle), filled).otherwise(
        F.concat_ws(" ", handle, filled)
    )
    cut = F.concat(F.substring(addressed, 1, limit - 3), F.lit("..."))
    return F.when(F.length(addressed) > limit, cut).otherwise(addressed)


def clean_draft(raw: Column, handle: Column, brand: Brand = BRAND) -> Column:
    """Generated draft without outer quotes, placeholders filled."""
    bare = F.regexp_replace(strip(raw), '^"+|"+$', "")
    bare = strip(F.regexp_replace(bare, "^'+|'+$", ""))
    return put_placeholders(bare, handle, brand)


def context_prompt(turns: Column, clean_text: Column) -> Column:
    """Classification prompt: all turns but the last as context, then the message.

    ``turns`` is an array of structs with ``author_id`` and ``text``.
    """
    lines = F.transform(
        F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))),
        lambda t: F.concat(F.lit("- "), t["author_id"], F.lit(": "), t["text"]),
    )
    context = F.when(
        F.size(turns) > 1,
        F.concat(F.lit("Said before:\n"), F.array_join(lines, "\n"), F.lit("\n\n")),
    ).otherwise(F.lit(""))
    return F.concat(
        context,
        F.lit("Message to label:\n"),
        clean_text,
        F.lit("\n\nAnswer with one JSON object."),
    )
