"""Files in and out: bitext JSON lines, vocabularies, word vectors, BPE models, encoded pairs, metrics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.operators.bpe import MAX_PIECES, BpeModel
from bitloom.plans.ranking import global_rank
from bitloom.plans.storage import fits, materialize, new_path


# The characters that Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


LINE_BITS = 34  # of a line id, for the number of a line in its file
SENT_BLOCKS = 2_000_000


def numbered_lines(spark: SparkSession, *paths: str, path_number: str | None = None) -> DataFrame:
    """``line_id, value``: the lines of text files, with ids that do not depend on how Spark cuts the files.

    An id is the number of the file (files of one path in the order of their
    names, later paths after earlier ones) times 2^34 plus the number of the
    line in its file, so it keeps the order of the lines; ``path_number`` names
    a column for the place of the path among ``paths``. Every plan on these
    rows sees the same ids, whatever the size of a split or the number of
    cores; files that are added or removed shift the numbers of those behind.

    The lines of each split are counted here, which reads the files once more
    without parsing them. The counts (one row for each 128 MB or so) are added
    up on the driver and go to all tasks if they are at most two million; beyond
    that they stay a table, which is joined. If the files or the sizes of splits
    have changed when rows are read, an error is raised instead of wrong ids.
    """
    located, placed = [], []
    for k, path in enumerate(paths):
        rows = spark.read.text(path).select(
            "value",
            F.lit(k).alias("_path"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
        )
        part = F.shiftright("_at", 33).alias("_part")
        located.append(rows.withColumn("_part", part))
        placed.append(
            rows.groupBy("_path", "_file", "_block", part).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
        )
    starts = _starts(spark, _all(placed))
    shift = F.coalesce("_shift", F.raise_error(F.lit("the files or their splits have changed since they were numbered")).cast("long"))
    joined = _all(located).join(starts, ["_path", "_file", "_block", "_part"], "left")
    found = [F.col("_path").alias(path_number)] if path_number else []
    return joined.select((F.col("_at") + shift).alias("line_id"), *found, "value")


def _starts(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """``_path, _file, _block, _part, _shift``: what makes a line id of a row number, for every split of a file."""
    keys = ["_path", "_file", "_block", "_part"]
    few = blocks.limit(SENT_BLOCKS + 1).collect()  # numbers of splits, not of lines
    if len(few) <= SENT_BLOCKS:
        shifts, file, before, last = [], -1, 0, None
        for row in sorted(few, key=lambda r: (r["_path"], r["_file"], r["_block"])):
            if (row["_path"], row["_file"]) != last:
                file, before, last = file + 1, 0, (row["_path"], row["_file"])
            shifts.append((*[row[k] for k in keys], (file << LINE_BITS) + before - row["_from"]))
            before += row["_n"]
        schema = "_path int, _file string, _block long, _part long, _shift long"
        return F.broadcast(spark.createDataFrame(shifts, schema))
    blocks = materialize(blocks, "text-blocks")
    order = Window.partitionBy("_path", "_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    files = global_rank(blocks.select("_path", "_file").distinct(), [F.col("_path"), F.col("_file")], name="_number")
    placed = blocks.join(files, ["_path", "_file"])
    number = F.shiftleft((F.col("_number") - 1).cast("long"), LINE_BITS)
    shift = number + F.coalesce(F.sum("_n").over(order), F.lit(0)) - F.col("_from")
    return materialize(placed.select(*keys, shift.alias("_shift")), "text-starts")


def _all(tables: Sequence[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def _parsed_lines(lines: DataFrame, src: str, tgt: str, keep: Sequence[str] = ()) -> DataFrame:
    """Parse one object per line; columns ``keep`` stay.

    The line is wrapped in a list, so that anything after the object makes it
    invalid instead of being ignored. The outer explode of a one-element array
    makes Spark parse each line once; filters would otherwise repeat the parsing.
    """

    def braced(text: Column) -> Column:
        return text.startswith("{") & text.endswith("}")

    line = F.when(braced(F.col("value")), F.col("value")).otherwise(F.btrim("value", F.lit(WHITESPACE)))
    schema = f"array<struct<`{src}`:string,`{tgt}`:string>>"
    wrapped = F.concat(F.lit("["), F.col("line"), F.lit("]"))
    objects = F.from_json(wrapped, schema, {"allowSingleQuotes": "false"})
    first = F.get("_o", F.lit(0))
    return (
        lines.select(*keep, line.alias("line"))
        .filter(F.col("line") != "")
        .select(*keep, "line", F.explode_outer(F.array(objects)).alias("_o"))
        .select(
            *keep,
            "line",
            F.coalesce(braced(F.col("line")) & (F.size("_o") == 1), F.lit(False)).alias("_ok"),
            first[src].alias("src"),
            first[tgt].alias("tgt"),
        )
    )


def _accepted(require_both: bool) -> Column:
    both = F.col("src").isNotNull() & F.col("tgt").isNotNull()
    return F.col("_ok") & both if require_both else F.col("_ok")


def bitext_from_lines(lines: DataFrame, src: str = "zh", tgt: str = "en", require_both: bool = True) -> DataFrame:
    """``src, tgt`` from a ``value`` column of JSON lines, batch or stream."""
    return _parsed_lines(lines, src, tgt).filter(_accepted(require_both)).select("src", "tgt")


def read_bitext_jsonl(
    spark: SparkSession, path: str, src: str = "zh", tgt: str = "en", require_both: bool = True, keyed: bool = True
) -> DataFrame:
    """Pairs of a JSON-lines file; blank and invalid lines are skipped, a missing file raises.

    ``pair_id`` is the place of the line (`numbered_lines`): unique, ascending
    in file order, and the same in every plan. Without ``keyed`` there is none,
    and the files are read once only.
    """
    if not keyed:
        return bitext_from_lines(spark.read.text(path), src, tgt, require_both)
    rows = _parsed_lines(numbered_lines(spark, path), src, tgt, ["line_id"]).filter(_accepted(require_both))
    return rows.select(F.col("line_id").alias("pair_id"), "src", "tgt")


def read_rejects(
    spark: SparkSession, path: str, src: str = "zh", tgt: str = "en", require_both: bool = True
) -> DataFrame:
    """The non-blank lines that `read_bitext_jsonl` skips."""
    return _parsed_lines(spark.read.text(path), src, tgt).filter(~_accepted(require_both)).select("line")


def read_splits(
    spark: SparkSession,
    paths: Mapping[str, str],
    src: str = "zh",
    tgt: str = "en",
    require_both: bool = True,
) -> DataFrame:
    """Several files as one table with a ``split`` column; ``pair_id`` is unique over all splits, see `numbered_lines`.

    The parsed rows are written once, so later plans neither parse nor depend on the files.
    """
    names = list(paths)
    lines = numbered_lines(spark, *paths.values(), path_number="split_number")
    rows = _parsed_lines(lines, src, tgt, ["line_id", "split_number"]).filter(_accepted(require_both))
    split = F.array(*[F.lit(n) for n in names])[F.col("split_number")]
    return materialize(rows.select(F.col("line_id").alias("pair_id"), "src", "tgt", split.alias("split")), "splits")


def write_bitext_jsonl(df: DataFrame, path: str, src: str = "zh", tgt: str = "en") -> None:
    df.select(F.col("src").alias(src), F.col("tgt").alias(tgt)).write.json(path)


def corpus_lines(bitext: DataFrame) -> DataFrame:
    """Two lines per pair: source, then target."""
    sides = F.array(
        F.struct(F.lit("src").alias("side"), F.col("src").alias("line")),
        F.struct(F.lit("tgt").alias("side"), F.col("tgt").alias("line")),
    )
    return bitext.select("pair_id", F.inline(sides))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)


def write_plain(lines: DataFrame, order: Sequence[str], path: str) -> None:
    """One text file, no folder, of the ``line`` column in the order of some columns.

    Tasks write sorted ranges below the shared folder; the driver then strings
    the finished parts together as streams of bytes, holding none of them, and
    gives the file its name at the end, so a reader sees all of it or nothing.
    An existing file raises.
    """
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target, parts = fs.Path(path), fs.Path(new_path(spark, "plain"))
    system, shared = target.getFileSystem(conf), parts.getFileSystem(conf)
    if system.exists(target):
        raise FileExistsError(path)
    keys = [F.col(c) for c in order]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.text(parts.toString())
    unfinished = fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = system.create(unfinished, False)
    try:
        for name in sorted(s.getPath().getName() for s in shared.listStatus(parts) if s.getPath().getName().startswith("part-")):
            part = shared.open(fs.Path(parts, name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    if not system.rename(unfinished, target):
        raise FileExistsError(path)


def _json_string(text: str) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def write_json_map(rows: DataFrame, key: str, value: str, path: str, before: str = "{", after: str = "}") -> None:
    """One JSON file ``{key: value, ...}`` in the order of the whole numbers ``value``, an entry a line; no row holds it all."""
    first = rows.agg(F.min(value)).first()[0]
    comma = F.when(F.col(value) > first, ", ").otherwise("")
    entries = rows.select(
        F.lit(1).alias("part"), F.col(value).cast("long").alias("at"), F.concat(comma, _json_string(key), F.lit(": "), F.col(value).cast("string")).alias("line")
    )
    ends = rows.sparkSession.createDataFrame([(0, 0, before), (2, 0, after)], "part int, at long, line string")
    write_plain(entries.unionByName(ends), ["part", "at"], path)


def export_vocab_file(vocab: DataFrame, name: str, path: str) -> None:
    """One language as one plain JSON file ``{"name", "word2idx"}``, in id order, of any size."""
    write_json_map(vocab, "token", "id", path, f'{{"name": {json.dumps(name)}, "word2idx": {{', "}}")


def export_bpe(model: BpeModel, path: str) -> None:
    """The model as plain files ``vocab.json`` and ``merges.txt`` in a folder, as tokenizer libraries read them."""
    write_json_map(model.vocab, "piece", "id", f"{path}/vocab.json")
    # Fixed value: the first line of the merges file.
    header = model.merges.sparkSession.createDataFrame([(-1, "#version: 0.2")], "rank int, line string")
    merges = model.merges.select("rank", F.concat_ws(" ", "left", "right").alias("line"))
    write_plain(header.unionByName(merges), ["rank"], f"{path}/merges.txt")


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.select("lang", "id", "token", "freq").write.partitionBy("lang").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.schema("lang string, id int, token string, freq long").parquet(path)
    return table.select("lang", "id", "token", "freq")


def export_vocab_json(vocab: DataFrame, name: str, path: str) -> None:
    """One language as one JSON document ``{"name", "word2idx"}``, in id order."""
    if not fits(vocab, MAX_PIECES):
        raise ValueError(f"only a vocabulary of at most {MAX_PIECES} entries fits one document")
    entries = F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "token")))
    in_order = F.transform(entries, lambda e: F.struct(e["token"], e["id"]))
    document = F.struct(F.lit(name).alias("name"), F.map_from_entries(in_order).alias("word2idx"))
    vocab.groupBy().agg(F.to_json(document).alias("value")).coalesce(1).write.text(path)


def import_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """``lang, id, token, freq`` from an exported document (frequencies are not stored)."""
    parsed = F.from_json("value", "name string, word2idx map<string,int>")
    return (
        spark.read.text(path, wholetext=True)
        .select(parsed.alias("v"))
        .select(F.col("v.name").alias("lang"), F.explode("v.word2idx").alias("token", "id"))
        .select("lang", "id", "token", F.lit(None).cast("long").alias("freq"))
    )


def read_word_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``line_no, token, vector`` from a text file of word vectors.

    ``line_no`` ascends in file order, see `numbered_lines`. Lines without exactly ``dim`` numbers (such as a header, or a line with
    something else among them) are skipped, and undecodable bytes are ignored.
    """
    valid = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    )
    parts = F.split(F.regexp_replace(valid, r"(?U)\s+$", ""), " ")
    return (
        numbered_lines(spark, path)
        .select(F.col("line_id").alias("line_no"), parts.alias("p"))
        .filter(F.size("p") == dim + 1)
        .select(
            "line_no", F.col("p")[0].alias("token"), F.transform(F.slice("p", 2, dim), lambda x: x.try_cast("float")).alias("vector")
        )
        .filter(F.forall("vector", lambda x: x.isNotNull()))
    )


def save_bpe(model: BpeModel, path: str) -> None:
    """The model as tables and as ``vocab.json`` and ``merges.txt`` (Spark text folders)."""
    model.vocab.coalesce(1).write.parquet(f"{path}/vocab")
    model.merges.coalesce(1).write.parquet(f"{path}/merges")
    entries = F.array_sort(F.collect_list(F.struct("id", "piece")))
    in_order = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["piece"], e["id"])))
    model.vocab.groupBy().agg(F.to_json(in_order).alias("value")).coalesce(1).write.text(f"{path}/vocab.json")
    # Fixed value: the first line of the merges file.
    header = model.merges.sparkSession.createDataFrame([(-1, "#version:", "0.2")], "rank int, left string, right string")
    lines = header.unionByName(model.merges).coalesce(1).sortWithinPartitions("rank")
    lines.select(F.concat_ws(" ", "left", "right").alias("value")).write.text(f"{path}/merges.txt")


def load_bpe(spark: SparkSession, path: str) -> BpeModel:
    """A saved model; a missing one raises."""
    return BpeModel(spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges"))


def import_bpe(spark: SparkSession, vocab_json: str, merges_txt: str) -> BpeModel:
    """A model from a ``vocab.json`` and a ``merges.txt``."""
    vocab = (
        spark.read.text(vocab_json, wholetext=True)
        .select(F.explode(F.from_json("value", "map<string,int>")).alias("piece", "id"))
        .select("id", "piece")
    )
    lines = F.filter(F.split("value", "\n"), lambda line: (line != "") & ~line.startswith("#version"))
    parts = F.split("line", " ")
    merges = (
        spark.read.text(merges_txt, wholetext=True)
        .select(F.posexplode(lines).alias("rank", "line"))
        .select("rank", parts[0].alias("left"), parts[1].alias("right"))
    )
    return BpeModel(vocab, merges)


def write_encoded(df: DataFrame, path: str) -> None:
    """Encoded pairs, one folder per split."""
    df.write.partitionBy("split").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
