"""URL filter: rules first, then words found inside host names.

Host names run words together. A unigram model of the words of the pages' own texts splits every name
by the Viterbi path of highest probability; multinomial naive Bayes then scores the words of host and
path. Its training labels are weak: a host that contains one of a list of unwanted words is a bad example,
any other a good one; what the words of bad hosts have in common carries over to hosts without them.

The listed words themselves are labels and not features, and a host's own urls are left out of the counts
that score its words, so naive Bayes says what the list does not say. A listed word adds fixed odds.

Names, words, tokens and paths are counted and joined by Spark; each distinct name is split once, each
distinct host and path shape is scored once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import fresh, materialise

# Words that mark a host as a bad example.
UNWANTED = ("ads", "bet", "bets", "casino", "gambling", "loans", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
# Longest word of the model and longest unknown piece.
LONGEST = 20
# The unwanted words enter the model as if each were one word in so many.
UNWANTED_SHARE = 20_000
SMOOTHING = 0.5
# Log odds of block that a listed word adds.
LISTED_ODDS = 6.0
MAX_RULES = 1_000

Rules = Sequence[tuple[str, str]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's. Rules are
    parameters of the query, MAX_RULES at most; of rules of equal length the first in string order holds.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        its_host, slash, its_path = rule.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(slash + its_path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) of the a-z words of whole texts, markup left out."""
    plain = F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), r"<[^>]*>|&\w+;", " "))
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}\p{M}]+")).alias("word"))
    # Words beyond a-z cannot stand in a host name; they are left out before any is counted.
    return words.where(F.col("word").rlike(f"^[a-z]{{1,{LONGEST}}}$")).groupBy("word").agg(F.count("*").alias("n"))


def names_of(host: Column) -> Column:
    """Letter runs of a host, in order: what stands between dots, hyphens and digits."""
    return F.filter(F.split(host, r"[^a-z]+"), lambda t: t != "")


def split_name(size: int, known: dict[tuple[int, int], float], unknown: float) -> list[tuple[int, int]]:
    """Viterbi over the places of a name: (start, length) of the words of the likeliest split.

    ``known`` has the log probability of words by place and length. A piece that is no word has a tenth of
    ``unknown`` per letter beyond the first. Ties go to the longer last piece.
    """
    best, came = [0.0] + [-math.inf] * size, [0] * (size + 1)
    for end in range(1, size + 1):
        for start in range(max(0, end - LONGEST), end):
            length = end - start
            score = best[start] + known.get((start, length), unknown - math.log(10) * (length - 1))
            if score > best[end]:
                best[end], came[end] = score, start
    out = []
    while size:
        out.append((came[size], size - came[size]))
        size = came[size]
    return out[::-1]


def split_names(names: DataFrame, model: DataFrame) -> DataFrame:
    """(name, words) for each distinct name; ``model`` has (word, n). Every substring meets the model by a join."""
    total = model.agg(F.sum("n")).first()[0] or 1
    unknown = math.log(1 / total)
    size = F.length("name")
    starts = names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    pieces = starts.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1))).alias("length"))
    pieces = pieces.withColumn("word", F.substr("name", "at", "length"))
    met = pieces.join(model, "word").groupBy("name").agg(F.collect_list(F.struct((F.col("at") - 1).alias("at"), "length", "n")).alias("met"))
    listed = names.join(met, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, met in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = {(m["at"], m["length"]): math.log(m["n"] / total) for m in met or []}
                out.append([name[s : s + n] for s, n in split_name(len(name), known, unknown)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return listed.select("name", "met").mapInArrow(run, "name string, words array<string>")


def path_tokens(path: Column) -> Column:
    """Tokens of a path; runs of digits are one token whatever the number."""
    return F.filter(F.split(F.regexp_replace(F.lower(path), "[0-9]+", "0"), r"[^\p{L}\p{M}0]+"), lambda t: t != "")


def judge(pages: DataFrame, rules: Rules, unwanted: Sequence[str] = UNWANTED) -> DataFrame:
    """All columns of ``pages`` (url, html) with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    ``rule`` is the longest rule that fits, else null; ``verdict`` is its, else ``block`` if naive Bayes
    gives at least one half, else ``allow``. ``block_score`` is the log odds of block by naive Bayes and the list,
    0 for a url without any token. Null and broken urls have empty host and path and no tokens, so ``allow``. Every
    row is judged, repeated rows alike; null html adds no words. An empty table gives no rows. Columns of
    ``pages`` named like an added one are refused.
    """
    added = ("host", "path", "rule", "verdict", "block_score")
    if clash := set(added) & {c.lower() for c in pages.columns}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    shape, host_score, path_score = fresh(pages, "path_shape", "host_score", "path_score")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("url").select(host.alias("host"), path_tokens(path).alias("tokens"))
    groups = materialise(parsed.groupBy("host", "tokens").agg(F.count("*").alias("n")))
    hosts = groups.groupBy("host").agg(F.sum("n").alias("n"))
    named = hosts.select("host", "n", F.posexplode(names_of(F.col("host"))).alias("at", "name"))
    named = materialise(named)

    counts = materialise(word_counts(pages, "html"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    extra = pages.sparkSession.createDataFrame([(w, max(1, total // UNWANTED_SHARE)) for w in unwanted], "word string, n bigint")
    names = named.select("name").distinct()
    # Only substrings of names can be met: the model is cut to them by the join in split_names.
    model = materialise(counts.unionByName(extra).groupBy("word").agg(F.sum("n").alias("n")))
    split = split_names(names, model)
    worded = named.join(split, "name").groupBy("host").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))
    worded = worded.select("host", "n", F.flatten("parts.words").alias("words"))
    bad = F.arrays_overlap("words", F.array(*[F.lit(w) for w in unwanted]))
    worded = materialise(worded.withColumn("bad", F.coalesce(bad, F.lit(False))))

    # Counts of every token in bad and good urls: host words, and path tokens under the label of their host.
    labelled = groups.join(worded.select("host", "bad"), "host", "left").select("tokens", "n", F.coalesce("bad", F.lit(False)).alias("bad"))
    # What a host's own urls add to the counts of its words.
    own = worded.select("host", "bad", "n", F.explode("words").alias("token")).where(~F.col("token").isin(list(unwanted)))
    own = materialise(own.groupBy("host", "token", "bad").agg(F.count("*").alias("times"), F.sum("n").alias("own")))
    tokens = own.select("token", "bad", F.col("own").alias("n")).unionByName(labelled.select(F.explode("tokens").alias("token"), "bad", "n"))
    split_n = [F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g")]
    table = materialise(tokens.groupBy("token").agg(*split_n))
    bad_tokens, good_tokens = table.agg(F.sum("b"), F.sum("g")).first()
    bad_urls, good_urls = labelled.agg(*split_n).first()
    # Smoothed by each label's share of all tokens: a token that was not seen says nothing.
    share = ((bad_tokens or 0) + SMOOTHING) / ((bad_tokens or 0) + (good_tokens or 0) + 2 * SMOOTHING)
    prior = math.log(((bad_urls or 0) + SMOOTHING) / ((good_urls or 0) + SMOOTHING))
    odds_of = lambda b, g: F.log((b / share + 1) / (g / (1 - share) + 1))
    weights = table.select("token", odds_of(F.col("b"), F.col("g")).alias("w"))

    others = own.join(table, "token").select(
        "host", "times", (F.col("b") - F.when(F.col("bad"), F.col("own")).otherwise(0)).alias("b"), (F.col("g") - F.when(F.col("bad"), 0).otherwise(F.col("own"))).alias("g")
    )
    by_words = others.groupBy("host").agg(F.sum(F.col("times") * odds_of(F.col("b"), F.col("g"))).alias("words_score"))
    listed_odds = F.when(F.col("bad"), F.lit(LISTED_ODDS)).otherwise(0.0)
    by_host = worded.where(F.size("words") > 0).join(by_words, "host", "left").select("host", (F.coalesce("words_score", F.lit(0.0)) + listed_odds).alias(host_score))
    shapes = groups.select("tokens").distinct()
    by_path = shapes.select(F.col("tokens").alias(shape), F.explode("tokens").alias("token")).join(weights, "token").groupBy(shape).agg(F.sum("w").alias(path_score))

    # Written, so that either join has a side of its own and a host or path that most pages share can be split.
    by_host, by_path = materialise(by_host), materialise(by_path)
    rows = pages.withColumns({"host": host, "path": path}).withColumn(shape, path_tokens(F.col("path")))
    rows = rows.join(by_host, "host", "left").join(by_path, shape, "left")
    some = F.col(host_score).isNotNull() | F.col(path_score).isNotNull()
    odds = F.when(some, F.coalesce(host_score, F.lit(0.0)) + F.coalesce(path_score, F.lit(0.0)) + prior).otherwise(0.0)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(some & (odds >= 0), "block").otherwise("allow")
    return rows.select(*pages.columns, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), odds.alias("block_score"))
