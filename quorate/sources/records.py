"""Question sets and document corpora from loosely structured JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.functions import text as tx
from quorate.operators.gates import require_empty
from quorate.session import broadcast_if_small
from quorate.sources.json_split import file_list, read_json_lines, read_json_values

# Positions inside one file; order over a corpus is file order, then position.
FILE_POSITIONS = 1_000_000_000_000


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that are there, in order, on whatever file system they name."""
    found = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            found.append(path)
    return found


def _start(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^[\s\x{feff}]*(\S)", 1)


def _only(raw: Column, schema: str, where: Column) -> Column:
    """A JSON text read as ``schema``; one that does not parse or holds more than one value is an error.

    Every record is a variant of its own, so the size of a file is not bounded by that of one value.
    """
    failed = F.raise_error(F.concat(F.lit("not one JSON value: "), where))
    # Inside brackets of their own, two values or a value and something behind it do not parse as one.
    found = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), f"array<{schema}>", {"mode": "FAILFAST"})
    return F.when(F.size(found) == 1, F.coalesce(found[0], failed)).otherwise(failed)


def _parsed(files: DataFrame, schema: str) -> Column:
    """The whole JSON text of each file read as ``schema``."""
    where = F.col("file") if "file" in files.columns else F.lit("a record")
    opening = "[" if schema.startswith("array") else "{"
    raw = F.regexp_replace("raw", r"^\x{feff}", "")
    # Tested again here: the planner may run the parser before the filter by opening.
    return F.when(_start(F.col("raw")) == opening, _only(raw, schema, where))


def _lists_and_objects(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that hold a list and files that hold an object; any other content is an error."""
    failed = F.raise_error(F.concat(F.lit("neither a list nor an object: "), F.substring("raw", 1, 80)))
    start = _start(F.col("raw"))
    known = files.where(F.when(start.isin("[", "{"), True).otherwise(failed.cast("boolean")))
    return known.where(start == "["), known.where(start == "{")


def _path(field: str) -> str:
    return f"$['{field}']"


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def _flat_text(v: Column) -> Column:
    """Text of a value that is not an array."""
    fields = [
        F.when(
            _is(F.variant_get(v, _path(f), "variant"), "STRING"), tx.strip(F.try_variant_get(v, _path(f), "string"))
        )
        for f in C.NESTED_TEXT_FIELDS
    ]
    whole = F.to_json(v)
    return (
        F.when(_is(v, "STRING"), tx.strip(F.try_variant_get(v, "$", "string")))
        .when(_is(v, "OBJECT"), F.coalesce(*fields, whole))
        .otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), whole))
    )


def value_text(v: Column) -> Column:
    """Readable text of a JSON value: string, first text field of an object, lines of a list."""
    parts = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: x.isNotNull() & ~F.is_variant_null(x))
    lines = F.array_join(F.transform(parts, _flat_text), "\n")
    return F.when(v.isNull() | F.is_variant_null(v), F.lit("")).when(_is(v, "ARRAY"), lines).otherwise(_flat_text(v))


def _first_field(v: Column, fields: Sequence[str], kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, _path(f), kind) for f in fields])


def corpus_records(files: DataFrame) -> DataFrame:
    """(file, doc_id, text, pos) of corpus files; ids and texts under any of the known field names.

    A list gives its objects (id by position when none is named, blank texts dropped); one object
    with a file name and data gives itself; any other object maps ids to values. A file that is no
    JSON list or object stops the job.
    """
    lists, objects = _lists_and_objects(files)
    mapped = objects.select("file", _parsed(objects, "map<string,variant>").alias("_m"))
    name, data = F.col("_m")["filename"], F.col("_m")["filedata"]
    single = name.isNotNull() & data.isNotNull()
    one = mapped.where(single).select(
        "file", F.try_variant_get(name, "$", "string").alias("doc_id"), value_text(data).alias("text"), F.lit(0).alias("pos")
    )
    keyed = mapped.where(~single).select("file", F.posexplode("_m").alias("pos", "doc_id", "value"))
    keyed = keyed.select("file", "doc_id", value_text(F.col("value")).alias("text"), "pos")
    listed = lists.select("file", "stem", F.posexplode(_parsed(lists, "array<variant>")).alias("pos", "value"))
    return one.unionByName(keyed).unionByName(_listed_records(listed))


def _listed_records(listed: DataFrame, *more: str) -> DataFrame:
    """(file, doc_id, text, pos) of list entries (file, stem, pos, value): objects whose text is not blank."""
    value = F.col("value")
    named = F.coalesce(
        _first_field(value, C.ID_FIELDS, "string"), F.concat("stem", F.format_string("_%05d", F.col("pos")))
    )
    body = F.coalesce(_first_field(value, C.TEXT_FIELDS, "variant"), value)
    many = listed.where(_is(value, "OBJECT")).select(*more, "file", named.alias("doc_id"), value_text(body).alias("text"), "pos")
    return many.where(tx.strip(F.col("text")) != "")


def entries(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``read_json_values`` and ``read_json_lines`` give, parsed: list elements and lines (path, file, stem, pos, value),
    and members of objects (the same with key)."""
    place = ("path", "file", "stem", "pos")
    # Tested again here, as the planner may run the parser before other filters.
    some = F.trim("raw") != ""
    value = F.when((F.col("kind") != "{") & some, _only(F.col("raw"), "variant", F.col("path")))
    member = F.when((F.col("kind") == "{") & some, _only(F.concat(F.lit("{"), "raw", F.lit("}")), "map<string,variant>", F.col("path")))
    listed = values.where("kind <> '{'").select(*place, value.alias("value"))
    return listed, values.where("kind = '{'").select(*place, F.explode(member).alias("key", "value"))


def corpus_of_values(values: DataFrame) -> DataFrame:
    """(path, file, doc_id, text, pos) like ``corpus_records``, from records that were cut out of files of any size.

    A JSON line is a record as an element of a list is.
    """
    listed, members = entries(values)
    # Two members of a file at most, and few files have them.
    parts = [F.first(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).alias(k) for k in ("filename", "filedata")]
    named = members.where(F.col("key").isin("filename", "filedata")).groupBy("path", "file").agg(*parts)
    named = named.where("filename is not null and filedata is not null")
    one = named.select("path", "file", F.try_variant_get("filename", "$", "string").alias("doc_id"), value_text(F.col("filedata")).alias("text"), F.lit(0).cast("bigint").alias("pos"))
    keyed = members.join(broadcast_if_small(named.select("path")), "path", "left_anti")
    keyed = keyed.select("path", "file", F.col("key").alias("doc_id"), value_text(F.col("value")).alias("text"), "pos")
    return one.unionByName(keyed).unionByName(_listed_records(listed, "path"))


def merge_corpora(parts: Sequence[DataFrame]) -> DataFrame:
    """(doc_id, text, load_order): later parts replace earlier texts, the first place is kept."""
    merged = None
    for i, part in enumerate(parts):
        one = part.select("doc_id", "text", F.lit(i).alias("_file"), F.col("pos").alias("_pos"))
        merged = one if merged is None else merged.unionByName(one)
    return _last_texts(merged)


def _last_texts(rows: DataFrame) -> DataFrame:
    """The last text of each id of (doc_id, text, _file, _pos), at the id's first place."""
    place = F.struct("_file", "_pos")
    return rows.groupBy("doc_id").agg(F.max_by("text", place).alias("text"), F.min(place).alias("p")).select(
        "doc_id", "text", (F.col("p._file").cast("bigint") * FILE_POSITIONS + F.col("p._pos")).alias("load_order")
    )


LINE_ENDINGS = (".jsonl", ".ndjson")


def read_values(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The records of JSON files of any layout; paths that end as JSON-lines files do are read as such, folders too."""
    lines = [p for p in paths if p.rstrip("/").endswith(LINE_ENDINGS)]
    whole = [p for p in paths if p not in lines]
    if not lines:
        return read_json_values(spark, whole)
    found = read_json_lines(spark, lines)
    return found.unionByName(read_json_values(spark, whole)) if whole else found


def _merged_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(doc_id, text, load_order) of all files in the given order, those of one folder by name."""
    order = dict.fromkeys(path for path, _ in file_list(spark, paths))
    ranks = spark.createDataFrame([(p, i) for i, p in enumerate(order)], "path string, _file int")
    found = corpus_of_values(read_values(spark, paths)).join(F.broadcast(ranks), "path")
    return _last_texts(found.select("doc_id", "text", "_file", F.col("pos").alias("_pos")))


def read_corpora(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several corpora merged in the given order; missing files are skipped."""
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], "doc_id string, text string, load_order bigint")
    return _merged_files(spark, there)


def synthetic_ids(documents: DataFrame) -> DataFrame:
    """Gate of a curated corpus: documents with an id made from an item's references."""
    name = F.col("doc_id")
    return documents.where(name.startswith(C.PROVISION_PREFIX) | name.startswith(C.RULING_PREFIX)).select("doc_id")


def read_curated_corpus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Corpus in the given file order; a missing file is an error, and so are synthetic ids."""
    if missing := sorted(set(paths) - set(existing(spark, paths))):
        raise FileNotFoundError(f"a curated corpus needs all its files; missing: {missing}")
    documents = _merged_files(spark, paths)
    require_empty(synthetic_ids(documents), "synthetic document ids in a curated corpus")
    return documents


def classify_references(v: Column) -> Column:
    """struct(provisions, rulings) from the first non-empty reference field of a record."""
    lists = []
    for f in C.REFERENCE_FIELDS:
        field = F.try_variant_get(v, _path(f), "variant")
        many = F.when(_is(field, "ARRAY"), F.try_variant_get(field, "$", "array<variant>")).otherwise(F.array(field))
        usable = field.isNotNull() & ~F.is_variant_null(field) & (F.size(many) > 0) & (F.to_json(field) != '""')
        lists.append(F.when(usable, many))
    chosen = F.coalesce(*lists)
    texts = F.filter(F.transform(chosen, lambda x: tx.strip(value_text(x))), lambda t: t != "")
    texts = F.coalesce(texts, F.array().cast("array<string>"))
    marks = "|".join(C.RULING_MARKS)
    return F.struct(
        F.filter(texts, lambda t: ~F.lower(t).rlike(marks)).alias("provisions"),
        F.filter(texts, lambda t: F.lower(t).rlike(marks)).alias("rulings"),
    )


def question_items(files: DataFrame) -> DataFrame:
    """(item_id, question, ground_truth, provisions, rulings, has_doc_ref) of question files.

    A file is a list of records, an object with "questions", or an object of records; entries that
    are not objects are skipped.
    """
    lists, objects = _lists_and_objects(files)
    inner = F.from_json("raw", "struct<questions:array<variant>>")["questions"]
    values = F.when(F.size(inner) > 0, inner).otherwise(F.map_values(_parsed(objects, "map<string,variant>")))
    records = lists.select(F.explode(_parsed(lists, "array<variant>")).alias("value"))
    records = records.unionByName(objects.select(F.explode(values).alias("value")))
    return items_from_records(records.where(_is(F.col("value"), "OBJECT")))


def questions_of_values(values: DataFrame) -> DataFrame:
    """Like ``question_items``, from records that were cut out of files of any size; a JSON line is a record."""
    listed, members = entries(values)
    inner = F.when(_is(F.col("value"), "ARRAY"), F.try_variant_get("value", "$", "array<variant>"))
    asked = members.where("key = 'questions'").where(F.size(inner) > 0).select("path", F.explode(inner).alias("value"))
    other = members.join(broadcast_if_small(asked.select("path").distinct()), "path", "left_anti").select("value")
    records = listed.select("value").unionByName(other).unionByName(asked.select("value"))
    return items_from_records(records.where(_is(F.col("value"), "OBJECT")))


def items_from_records(records: DataFrame, value: str = "value") -> DataFrame:
    """Canonical items from JSON records (a variant column)."""
    v = F.col(value)

    def field(name: str) -> Column:
        return value_text(F.try_variant_get(v, _path(name), "variant"))

    def first_text(*names: str) -> Column:
        return F.coalesce(*[F.nullif(field(n), F.lit("")) for n in names], F.lit(""))

    number = F.try_variant_get(v, "$.question_number", "bigint")
    rows = records.select(
        F.format_string("q_%04d", number).alias("item_id"),
        first_text("question_text", "question_summary").alias("question"),
        first_text("answer_cleaned", "answer").alias("ground_truth"),
        classify_references(v).alias("_r"),
    )
    return rows.select(
        "item_id",
        "question",
        "ground_truth",
        "_r.provisions",
        "_r.rulings",
        (F.size("_r.provisions") + F.size("_r.rulings") > 0).alias("has_doc_ref"),
    )


def corpus_of_items(items: DataFrame, order: str) -> DataFrame:
    """(doc_id, text, load_order) of the items' own references; the first occurrence of a text wins."""

    def side(prefix: str, column: str, kind: int) -> DataFrame:
        return items.select(
            F.col(order).alias("_o"),
            F.lit(kind).alias("_k"),
            "item_id",
            F.lit(prefix).alias("_prefix"),
            F.posexplode(column).alias("_p", "text"),
        )

    both = side(C.PROVISION_PREFIX, "provisions", 0).unionByName(side(C.RULING_PREFIX, "rulings", 1))
    first = both.groupBy("text").agg(
        F.min(F.struct("_o", "_k", "_p", "item_id", "_prefix")).alias("f")
    )
    name = F.concat("f._prefix", F.col("f.item_id").cast("string"), F.format_string("_%02d", F.col("f._p")))
    order_key = (F.col("f._o") * 2 + F.col("f._k")) * 100_000 + F.col("f._p")
    return first.select(name.alias("doc_id"), "text", order_key.cast("bigint").alias("load_order"))


_ANNOTATION = "map<string,array<struct<file:string,artigos:array<struct<artigo:string>>>>>"


def _annotation_blocks(items: DataFrame, column: str) -> DataFrame:
    """(item_id, title, block) of annotation JSON strings; other strings are ignored."""
    texts = items.select("item_id", F.explode(column).alias("_t"))
    parsed = texts.select("item_id", F.from_json("_t", _ANNOTATION).alias("_m"))
    return parsed.select("item_id", F.explode("_m").alias("title", "_b")).select(
        "item_id", "title", F.explode("_b").alias("block")
    )


def expected_pairs(items: DataFrame, column: str = "references") -> DataFrame:
    """Distinct (item_id, source_doc, anchor) that the annotations name."""
    blocks = _annotation_blocks(items, column)
    file = tx.strip(F.col("block.file"))
    rows = blocks.where(file != "").select("item_id", file.alias("source_doc"), F.explode("block.artigos").alias("a"))
    raw = F.col("a.artigo")
    return (
        rows.where(raw.isNotNull() & (raw != ""))
        .select("item_id", "source_doc", tx.normalise_article(raw).alias("anchor"))
        .distinct()
    )


def expected_documents(items: DataFrame, column: str = "raw") -> DataFrame:
    """Distinct (item_id, source_doc) named under "file" or "filename" anywhere in nested JSON; the
    first of the two keys that names any is used."""

    def named(key: str) -> Column:
        return F.filter(
            F.transform(F.regexp_extract_all(column, F.lit(rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*+)"'), 1), tx.strip),
            lambda x: x != "",
        )

    first = F.when(F.size(named("file")) > 0, named("file")).otherwise(named("filename"))
    return items.select("item_id", F.explode(F.array_distinct(first)).alias("source_doc"))


def citation_lines(items: DataFrame, column: str = "references") -> DataFrame:
    """(item_id, pos, citation): "title — art. X, art. Y" per annotated block; the text itself where
    it is not an annotation."""
    texts = items.select("item_id", F.posexplode(column).alias("pos", "_t"))
    parsed = texts.withColumn("_m", F.from_json("_t", _ANNOTATION)).withColumn(
        "_e", F.when(F.try_parse_json("_t").isNotNull(), F.map_entries("_m"))
    )
    lines = F.flatten(
        F.transform(
            F.col("_e"),
            lambda e: F.transform(
                e["value"],
                lambda b: F.concat(
                    e["key"],
                    F.when(
                        F.size(F.coalesce(b["artigos"], F.array())) > 0,
                        F.concat(
                            F.lit(" — "),
                            F.array_join(F.transform(b["artigos"], lambda a: F.concat(F.lit("art. "), a["artigo"])), ", "),
                        ),
                    ).otherwise(F.lit("")),
                ),
            ),
        )
    )
    shown = F.coalesce(lines, F.array("_t"))
    return parsed.select("item_id", "pos", F.posexplode(shown).alias("line", "citation"))
