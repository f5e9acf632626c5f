"""Text rules: titles, keys, redacted labels, boundary classes, escapes, leak patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word and phrase lists.
STOP_WORDS = ["a", "an", "and", "the", "to", "for", "of", "in", "on", "that", "this", "please", "now", "also"]
NOT_SWITCH = ["switch statement", "switch case", "switch expression", "switch block", "switch syntax", "switch branch"]
SWITCH = ["switch topics", "switch to", "switch gears", "switch context", "new task", "unrelated", "separately", "start working on", "pause this"]
CHILD = ["regression test", "add test", "add a test", "document the fix", "document this fix", "benchmark", "microbenchmark", "extract", "investigate", "profile"]
CONTINUE = ["also", "continue", "same", "that", "nearby", "follow up", "follow-up", "followup", " too", "above", "keep going", "finish"]
LEAKS = ["CANARY_SECRET", "CANARY_LEAK", "SUPER_SECRET", "sk-proj-", "ghp_", "BEGIN PRIVATE KEY"]
PAYLOADS = ['"raw_prompt"', '"raw_completion"', '"user_prompt_content"']
STORAGE_MODE = '"prompt_storage_mode"'

#: Letters A-Z only; other letters keep their case.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def has_any(text: Column, phrases: list[str]) -> Column:
    found = F.contains(text, F.lit(phrases[0]))
    for p in phrases[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def title(text: Column) -> Column:
    """A readable title: scope, dashes and underscores go, words begin upper-case."""
    bare = F.when(text.startswith("@"), F.when(F.contains(text, F.lit("/")), F.regexp_replace(text, r"^[^/]*/", "")).otherwise(F.substring(text, 2, 1 << 30))).otherwise(text)
    words = F.filter(F.split(F.translate(bare, "-_", "  "), r"\s+"), lambda w: w != "")
    raised = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.when(F.size(raised) > 0, F.array_join(raised, " ")).otherwise("Personal Unassigned")


def slug(text: Column) -> Column:
    """A key: runs of other characters become one dash, letters lower-case."""
    out = F.regexp_replace(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(out != "", out).otherwise("personal-unassigned")


def _starts(word: Column, heads: list[str]) -> Column:
    found = word.startswith(heads[0])
    for h in heads[1:]:
        found = found | word.startswith(h)
    return found


def redacted_label(text: Column) -> Column:
    """Three to eight words of a text, without secrets, addresses and stop words."""
    raw = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def mark(words: Column) -> Column:
        names = ["api_key", "token", "password"]
        # A name, a sign and a value in three words. One that begins inside another is part of it:
        # from left to right, the place where the last one ends is carried along.
        opens = lambda i: ascii_lower(F.get(words, i)).isin(names) & F.get(words, i + 1).isin("=", ":") & F.get(words, i + 2).isNotNull()
        found = F.filter(F.transform(words, lambda w, i: F.when(opens(i), i)), lambda i: i.isNotNull())
        kept = F.aggregate(found, F.array().cast("array<int>"), lambda out, i: F.when((F.size(out) == 0) | (i > F.try_element_at(out, F.lit(-1)) + 2), F.array_append(out, i)).otherwise(out))

        def with_starts(starts: Column) -> Column:
            def one(w: Column, i: Column) -> Column:
                low = ascii_lower(w)
                long = F.octet_length(w) >= 10
                secret = (
                    (low.startswith("sk-") & long)
                    | (_starts(low, ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]) & long)
                    | (_starts(low, ["api_key", "apikey", "token", "password"]) & low.rlike("[=:]"))
                )
                inside = F.array_contains(starts, i - 1) | F.array_contains(starts, i - 2)
                shown = F.regexp_replace(w, r"[^\p{L}\p{N}\[\]\-]", " ")
                return (
                    F.when(inside, "")
                    .when(secret | F.array_contains(starts, i), "[redacted]")
                    .when(_starts(w, ["http://", "https://"]), "")
                    .otherwise(shown)
                )

            return F.transform(words, one)

        return F.transform(F.array(kept), with_starts)[0]

    marked = F.transform(F.array(raw), mark)[0]
    words = F.filter(F.split(F.array_join(marked, " "), r"\s+"), lambda w: (w != "") & ((w == "[redacted]") | ~ascii_lower(w).isin(STOP_WORDS)))
    eight = F.slice(words, 1, 8)
    padded = F.concat(eight, F.array_repeat(F.lit("work"), F.greatest(F.lit(0), F.lit(3) - F.size(eight))))
    return F.array_join(padded, " ")


def boundary(text: Column, open_parent: Column, issue_changed: Column, asked_for_parent: Column) -> Column:
    """struct(outcome, score): whether a request goes on, branches off, or switches; first match wins."""
    low = ascii_lower(text)
    not_switch = has_any(low, NOT_SWITCH)
    switch = issue_changed | (~not_switch & has_any(low, SWITCH))
    child = open_parent & (has_any(low, CHILD) | asked_for_parent)
    word_it = low.rlike(r"(?<![\p{L}\p{N}])it(?![\p{L}\p{N}])")
    goes_on = has_any(low, CONTINUE) | word_it | not_switch
    result = lambda outcome, score: F.struct(F.lit(outcome).alias("outcome"), F.lit(score).alias("score"))
    return F.when(switch, result("SWITCH", 0.92)).when(child, result("CHILD", 0.90)).when(goes_on, result("CONTINUE", 0.82)).otherwise(result("UNCERTAIN", 0.45))


def html_escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def csv_escape(text: Column) -> Column:
    """Quotes doubled; a quote before what a spreadsheet would take for a formula."""
    doubled = F.replace(text, F.lit('"'), F.lit('""'))
    return F.when(text.rlike(r"^[\t\r\n]") | text.rlike(r"^\s*[=+\-@|%]"), F.concat(F.lit("'"), doubled)).otherwise(doubled)


def leaks(text: Column) -> Column:
    """True for text that holds a secret or a raw payload."""
    raw = has_any(ascii_lower(text), PAYLOADS) & ~F.contains(text, F.lit(STORAGE_MODE))
    return has_any(text, LEAKS) | raw


def spool_leaks(line: Column) -> Column:
    """True for a line of the spool that holds a secret, or a prompt or completion as text at its top."""
    at = lambda name: F.try_variant_get(F.try_parse_json(line), f"$.{name}", "variant")

    def told(name: str) -> Column:
        return (F.schema_of_variant(at(name)) == "STRING") & (F.try_variant_get(at(name), "$", "string") != "")

    keys = F.json_object_keys(line)
    raw = F.array_contains(keys, "raw_prompt") | F.array_contains(keys, "raw_completion")
    return leaks(line) | F.coalesce(told("prompt"), F.lit(False)) | F.coalesce(told("completion"), F.lit(False)) | F.coalesce(raw, F.lit(False))


# Words from so many bytes on are held against the line; a message is cut at so many bytes, with this mark.
WORD_BYTES, MESSAGE_BYTES, CUT = 4, 300, "…[truncated]"


def scrub(message: Column, raw: Column) -> Column:
    """An error message without the words of the line it is about, cut after the last whole character within MESSAGE_BYTES.

    Words of WORD_BYTES and more in UTF-8, less the signs around them, that stand in
    the line become a mark: two wide characters are a word already."""
    tokens = F.filter(F.split(raw, r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= WORD_BYTES)

    def clean(known: Column) -> Column:
        def one(word: Column) -> Column:
            core = F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
            return F.when((F.octet_length(core) >= WORD_BYTES) & F.array_contains(known, core), "[redacted]").otherwise(word)

        words = F.filter(F.split(message, r"\s+"), lambda w: w != "")
        return F.array_join(F.transform(words, one), " ")

    out = F.transform(F.array(F.coalesce(tokens, F.array().cast("array<string>"))), clean)[0]
    part = lambda n: F.substring(out.cast("binary"), 1, n).cast("string")
    whole = F.coalesce(*(F.when(F.is_valid_utf8(part(n)), part(n)) for n in range(MESSAGE_BYTES, MESSAGE_BYTES - 4, -1)))
    return F.when(F.octet_length(out) > MESSAGE_BYTES, F.concat(whole, F.lit(CUT))).otherwise(out)


def model_name(blob: Column, family: str = "gemini") -> Column:
    """The first name of a model family in a text, without a trailing -control; null for none."""
    found = F.regexp_extract(blob, family + r"-[A-Za-z0-9.\-]*", 0)
    bare = F.regexp_replace(found, r"(-control)+$", "")
    return F.when(bare != "", bare)


def rfc3339(text: Column) -> Column:
    """The instant of an RFC 3339 text with any offset and any fraction of a second (kept to microseconds); null for any other."""
    sound = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    short = F.regexp_replace(F.upper(text), r"(\.\d{6})\d+", "$1")
    return F.when(sound, F.try_to_timestamp(short))
