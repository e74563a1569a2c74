"""Text as column expressions: words, tokens, sentences, window packing, anchors, HTML, outputs."""

from __future__ import annotations

import html as _html
import html.entities as _entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions import constants as C

# White space as Unicode defines it for strings (control separators, no-break and wide spaces).
WS = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
NOT_WORD = rf"[^\p{{L}}\p{{N}}_{WS}]"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column, remove_stop_words: bool = True) -> Column:
    """Lexical tokens: lower case, punctuation to blanks, stop words and single letters dropped."""
    clean = F.regexp_replace(F.lower(text), NOT_WORD, " ")
    if not remove_stop_words:
        return words(clean)
    # Empty parts have no letter either, so one pass does.
    return F.filter(F.split(clean, f"[{WS}]+"), lambda t: (F.length(t) > 1) & ~t.isin(*C.STOP_WORDS))


def paragraphs(text: Column, separator: str = C.PARAGRAPH_SEPARATOR) -> Column:
    parts = F.transform(F.split(text, r"\Q" + separator + r"\E"), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    """Cut after . ! ? and white space when an ASCII capital follows."""
    parts = F.transform(F.split(text, rf"(?<=[.!?])[{WS}]+(?=[A-Z])"), strip)
    return F.filter(parts, lambda p: p != "")


_WINDOW = "struct<s:int,e:int>"
# Closed windows that gather before they move to the list of all.
RECENT_WINDOWS = 256


def pack_windows(units: Column, counter, max_tokens: int, overlap: int) -> Column:
    """Join consecutive units into windows of at most ``max_tokens``.

    A unit above the limit stands alone.  When a window closes, the next one starts with the longest
    run of its last whole units that has at most ``overlap`` tokens.  The fold keeps only unit
    positions and running token totals.  Closed windows gather in a short list, so that not all of them are
    copied whenever one closes.
    """
    counted = F.transform(units, lambda u: F.struct(u.alias("u"), counter(u).alias("n")))
    start = F.struct(
        F.array().cast(f"array<array<{_WINDOW}>>").alias("done"),
        F.array().cast(f"array<{_WINDOW}>").alias("recent"),
        F.lit(0).alias("i"),
        F.array().cast("array<int>").alias("open"),
        F.lit(0).alias("total"),
    )
    empty, none = F.array().cast("array<int>"), F.array().cast(f"array<{_WINDOW}>")

    def window(s: Column, e: Column) -> Column:
        return F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))

    def step(acc: Column, x: Column) -> Column:
        i, open_, total, n = acc["i"], acc["open"], acc["total"], x["n"]
        has_open = F.size(open_) > 0
        used = F.when(has_open, total - F.element_at(open_, 1)).otherwise(0)
        closed = F.when(
            has_open, F.concat(acc["recent"], window(i - F.size(open_), i))
        ).otherwise(acc["recent"])
        oversize = n > max_tokens
        flush = has_open & (used + n > max_tokens)
        kept = F.filter(open_, lambda before: total - before <= overlap)
        recent = (
            F.when(oversize, F.concat(closed, window(i, i + 1)))
            .when(flush, closed)
            .otherwise(acc["recent"])
        )
        # What was full before this unit moves on; the two lists are never both long.
        full = F.size(acc["recent"]) >= RECENT_WINDOWS
        done = F.when(full, F.concat(acc["done"], F.array(acc["recent"]))).otherwise(acc["done"])
        kept_size = F.size(acc["recent"])
        recent = F.when(full, F.slice(recent, kept_size + 1, F.size(recent))).otherwise(recent)
        next_open = (
            F.when(oversize, empty)
            .when(flush, F.concat(kept, F.array(total)))
            .otherwise(F.concat(open_, F.array(total)))
        )
        return F.struct(
            done.alias("done"), recent.alias("recent"), (i + 1).alias("i"), next_open.alias("open"), (total + n).alias("total")
        )

    def finish(acc: Column) -> Column:
        tail = F.when(
            F.size(acc["open"]) > 0, window(acc["i"] - F.size(acc["open"]), acc["i"])
        ).otherwise(none)
        return F.concat(F.flatten(acc["done"]), acc["recent"], tail)

    def render(bound: Column) -> Column:
        folded = F.aggregate(bound["c"], start, step, finish)
        return F.transform(
            folded,
            lambda w: F.array_join(
                F.transform(
                    F.slice(bound["c"], w["s"] + 1, w["e"] - w["s"]), lambda x: x["u"]
                ),
                " ",
            ),
        )

    # Binding the counted units once keeps them from being recomputed inside the fold.
    return F.element_at(F.transform(F.array(F.struct(counted.alias("c"))), render), 1)


def chunk_texts(
    text: Column,
    max_tokens: int = C.CHUNK_MAX_TOKENS,
    overlap: int = C.CHUNK_OVERLAP_TOKENS,
    separator: str = C.PARAGRAPH_SEPARATOR,
    counter=word_count,
) -> Column:
    """Windows of paragraphs; a window above the limit is packed again from its sentences."""

    def split_again(w: Column) -> Column:
        return F.when(
            counter(w) > max_tokens, pack_windows(sentences(w), counter, max_tokens, overlap)
        ).otherwise(F.array(w))

    windows = pack_windows(paragraphs(text, separator), counter, max_tokens, overlap)
    return F.flatten(F.transform(windows, split_again))


def normalise_article(article: Column) -> Column:
    """Article label: ordinal marks and final dots dropped, upper case (1º to 1, 12-a to 12-A)."""
    folded = strip(F.translate(article, "ºª", "oa"))
    return F.upper(strip(F.regexp_replace(folded, "[o°.]+$", "")))


ANCHOR_CHARS = r"^[0-9A-Z.\-]+$"


def article_anchors(text: Column) -> Column:
    """Every article label that a heading "Art. N" or "Artigo N" in the text matches.

    From each number token come all its prefixes that end before a non-digit, with leading zeros
    kept or dropped, so that matching a label is an equality.
    """
    found = F.regexp_extract_all(
        F.upper(text), F.lit(r"ART(?:IGO)?\.?[" + WS + r"]*(?=(\d[\dA-Z.\-]*))"), 1
    )

    def unzeroed(token: Column) -> Column:
        zeros = F.length(token) - F.length(F.regexp_replace(token, "^0+", ""))
        return F.transform(F.sequence(F.lit(0), zeros), lambda z: F.substring(token, z + 1, F.length(token)))

    def prefixes(token: Column) -> Column:
        sizes = F.filter(
            F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1))),
            lambda n: ~F.substring(token, n + 1, F.lit(1)).rlike("[0-9]") & (n <= F.length(token)),
        )
        return F.transform(sizes, lambda n: F.substring(token, F.lit(1), n))

    every = F.flatten(F.transform(F.array_distinct(found), unzeroed))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(every), prefixes)))


def article_pattern(anchor: Column) -> Column:
    """Regular expression of a heading for one label, for labels outside the plain alphabet."""
    quoted = F.concat(F.lit(r"\Q"), anchor, F.lit(r"\E"))
    return F.concat(F.lit(r"(?iu)art(?:igo)?\.?[" + WS + "]*0*"), quoted, F.lit(r"(?!\d)"))


# Elements whose content is raw text and invisible, and elements that hide what they hold.
_RAW, _HIDING = "script|style", "title|head"
_REST = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>"""
_TAG = rf"<[A-Za-z/!?]{_REST}"
_HIDING_TAG = rf"(?i)<(?:/?)(?:{_HIDING})(?=[\s/>]){_REST}"
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Longest name that may stand without its semicolon.
_SHORT = max(len(n) for n in _entities.html5 if not n.endswith(";"))


def _table(entries: dict) -> Column:
    """A constant map, as one literal."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _numeric(reference: Column) -> Column:
    """The character of a numeric reference by the rules of HTML: old code pages mended, what is no character dropped."""
    digits = F.regexp_extract(reference, "^#[xX]?([0-9a-fA-F]+)", 1)
    base16 = reference.rlike("^#[xX]")
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    code = F.when(base16, F.conv(short, 16, 10)).otherwise(short).cast("bigint")
    # The standard table's own answers for the first codes, which follow no rule.
    first = {str(c): _html.unescape(f"&#{c};") for c in range(0xA0) if _html.unescape(f"&#{c};") != chr(c)}
    lone = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when((F.length(short) > 9) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code < 0xA0, F.coalesce(_table(first)[code.cast("string")], lone))
        .when(code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE), "")
        .otherwise(lone)
    )


def unescape_entities(text: Column) -> Column:
    """Named and numeric character references to characters, by the standard table; unknown ones stay."""
    names = _table(_entities.html5)
    legacy = _table({n: c for n, c in _entities.html5.items() if not n.endswith(";")})

    def resolved(part: Column) -> Column:
        def read(b: Column) -> Column:
            m, rest = b["m"], b["rest"]
            prefix = [
                F.when(F.length(m) > n, F.concat(legacy[F.substring(m, 1, n)], F.substr(m, F.lit(n + 1)), rest)) for n in range(_SHORT, 1, -1)
            ]
            named = F.coalesce(F.concat(names[m], rest), *prefix, F.concat(F.lit("&"), part))
            return F.when(m == "", F.concat(F.lit("&"), part)).when(m.startswith("#"), F.concat(_numeric(m), rest)).otherwise(named)

        m = F.regexp_extract(part, _REFERENCE, 1)
        bound = F.array(F.struct(m.alias("m"), F.substr(part, F.length(m) + 1).alias("rest")))
        return F.element_at(F.transform(bound, read), 1)

    parts = F.split(text, "&")
    later = F.transform(F.slice(parts, F.lit(2), F.size(parts)), resolved)
    return F.when(F.contains(text, F.lit("&")), F.concat(parts[0], F.array_join(later, ""))).otherwise(text)


def _shown(body: Column) -> Column:
    """What stands outside of hiding elements: tags open and close them, and one left open hides all that follows."""
    tags = F.regexp_extract_all(body, F.lit(f"({_HIDING_TAG})"), 1)
    steps = F.transform(tags, lambda t: F.when(t.endswith("/>"), 0).when(t.startswith("</"), -1).otherwise(1))
    start = F.struct(F.lit(0).alias("n"), F.array(F.lit(True)).alias("shown"))

    def step(acc: Column, by: Column) -> Column:
        n = F.greatest(acc["n"] + by, F.lit(0))
        return F.struct(n.alias("n"), F.concat(acc["shown"], F.array(n == 0)).alias("shown"))

    shown = F.aggregate(steps, start, step, lambda acc: acc["shown"])
    return F.array_join(F.zip_with(F.split(body, _HIDING_TAG), shown, lambda p, ok: F.when(ok, p)), " ")


def html_text(page: Column) -> Column:
    """Visible text: comments, raw elements, what hiding elements hold, and tags dropped; references resolved,
    white space collapsed.  An element that is left open hides the rest."""
    body = F.regexp_replace(page, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, rf"(?is)<({_RAW})(?=[\s/>]){_REST}.*?(?:</\1[{WS}]*>|\z)", " ")
    body = unescape_entities(F.regexp_replace(_shown(body), _TAG, " "))
    return F.trim(F.regexp_replace(body, f"[{WS}]+", " "))


def spaced(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.array_join(words(text), " ")


def word_runs(text: Column, size: int) -> Column:
    """All runs of ``size`` consecutive words of a text whose words are joined by single blanks.

    One pass of a zero-width pattern that captures the run ahead of each word start.
    """
    run = rf"(?<![^ ])(?=((?:[^ ]++ ){{{size - 1}}}[^ ]++))"
    return F.regexp_extract_all(text, F.lit(run), 1)


def shared_run(original: Column, new: Column, window: int = C.SHARED_RUN_WORDS) -> Column:
    """True when some run of ``window`` words of the original occurs in the new text; a shorter
    original must occur whole; an empty one never does."""

    def test(b: Column) -> Column:
        blank = F.lit(" ")
        whole = F.contains(F.concat(blank, b["n"], blank), F.concat(blank, b["o"], blank))
        overlap = F.arrays_overlap(word_runs(b["o"], window), word_runs(b["n"], window))
        size = F.size(F.split(b["o"], " "))
        return F.when(b["o"] == "", F.lit(False)).when(size < window, whole).otherwise(overlap)

    bound = F.array(F.struct(spaced(original).alias("o"), spaced(new).alias("n")))
    return F.element_at(F.transform(bound, test), 1)


def source_type(name: Column) -> Column:
    """Pseudo document, ruling or norm, by the name of the source."""
    return (
        F.when(name.startswith(C.PROVISION_PREFIX) | name.startswith(C.RULING_PREFIX), "pseudo_doc")
        .when(name.rlike(C.RULING_NAME_PATTERN), "ruling")
        .otherwise("norm")
    )


_FENCE = r"```(?:json)?[" + WS + "]*"
_OBJECT = r"(?s)\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
_ACCENTED, _PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"


def json_object(raw: Column) -> Column:
    """The output itself when it is JSON, else its first object, else null; fences are removed."""
    clean = strip(F.regexp_replace(raw, _FENCE, ""))
    first = F.regexp_extract(clean, _OBJECT, 0)
    return F.when(F.try_parse_json(clean).isNotNull(), clean).when(
        F.try_parse_json(F.nullif(first, F.lit(""))).isNotNull(), first
    )


def canonical_key(key: Column) -> Column:
    return strip(F.translate(F.lower(key), _ACCENTED, _PLAIN))


def answer_fields(raw: Column, text_field: str = "resposta", score_field: str = "confianca") -> Column:
    """struct(valid_json, response_text, confidence_raw) of a model output.

    Keys match without case and accents, an exact key wins; the text must be a JSON string and the
    score a number in [0, 1], otherwise the output is invalid.
    """
    entries = F.map_entries(F.from_json(json_object(raw), "map<string,string>"))

    def pick(name: str) -> Column:
        exact = F.filter(entries, lambda e: e["key"] == name)
        alike = F.filter(entries, lambda e: canonical_key(e["key"]) == name)
        return F.coalesce(F.get(exact, F.lit(0))["value"], F.get(alike, F.lit(0))["value"])

    text, score = pick(text_field), pick(score_field).try_cast("double")
    valid = F.coalesce(text.isNotNull() & score.between(0.0, 1.0), F.lit(False))
    return F.struct(
        valid.alias("valid_json"),
        F.when(valid, text).alias("response_text"),
        F.when(valid, score).alias("confidence_raw"),
    )


def verdict_fields(raw: Column) -> Column:
    """struct(verdict, reasoning): from JSON with a verdict in 0..2, else by pattern, else -1."""
    text = strip(F.regexp_replace(strip(raw), r"^```(?:json)?|```$", ""))
    parsed = F.try_parse_json(text)
    number = F.try_variant_get(parsed, "$.veredicto", "int")
    reason = F.try_variant_get(parsed, "$.raciocinio", "string")
    good = F.coalesce(number.isin(0, 1, 2) & reason.isNotNull(), F.lit(False))
    found = F.regexp_extract(text, r'"veredicto"\s*:\s*([012])', 1).try_cast("int")
    partial = F.regexp_extract(text, r'(?s)"raciocinio"\s*:\s*"(.*?)(?:"|$)', 1)
    has_partial = text.rlike(r'(?s)"raciocinio"\s*:\s*"(.*?)(?:"|$)')
    return F.struct(
        F.when(good, number).otherwise(F.coalesce(found, F.lit(-1))).alias("verdict"),
        F.when(good, reason)
        .when(has_partial, partial)
        .otherwise(F.substring(text, 1, 500))
        .alias("reasoning"),
    )
