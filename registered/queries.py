"""The registered queries: every operator on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import ids as idf
from bitloom.functions import text as tx
from bitloom.functions.ngrams import repeated_ngrams, tokenize_13a
from bitloom.operators import batching, bleu, bpe, counting, coverage, encoding, hooks, lengths, metrics
from bitloom.operators import segment, selection, sentences, sketches, vectors
from bitloom.operators.unseen import train_unseen_words
from bitloom.plans.storage import materialize, new_path, spread
from bitloom.sources import files
from bitloom.sources.tables import bitext_from_turns, load
from bitloom.streaming import jobs

PREFIX = "translate Chinese to English: "
LATIN = "abcdefghijklmnopqrstuvwxyz0123456789"
HAN = "".join(chr(0x4E00 + i) for i in range(len(LATIN)))  # one Chinese character for each of them
BPE_SIZE = 8000


# ---- inputs ---------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "lang", "text")


def doc_tokens(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", "lang", tx.tokenize_ws("text").alias("tokens"))


def doc_counts(spark, sf) -> DataFrame:
    return counting.token_counts(doc_tokens(spark, sf))


def bitext(spark, sf) -> DataFrame:
    return bitext_from_turns(load(spark, sf, "conversations"))


def split_of(pair_id: Column) -> Column:
    digit = F.shiftright(pair_id, 32) % 10
    return F.when(digit == 0, "test").when(digit == 1, "validation").otherwise("train")


def pair_tokens(spark, sf) -> DataFrame:
    return bitext(spark, sf).select(
        "pair_id",
        "src",
        "tgt",
        tx.tokenize_ws("src", once=True).alias("src_tokens"),
        tx.tokenize_ws("tgt", once=True).alias("tgt_tokens"),
    )


def side_tokens(spark, sf) -> DataFrame:
    """One row per side; the side stands for the language."""
    return files.corpus_lines(bitext(spark, sf)).select(
        "pair_id", F.col("side").alias("lang"), tx.tokenize_ws("line").alias("tokens")
    )


def side_vocab(spark, sf, min_freq=2, max_size=2000) -> DataFrame:
    return counting.build_vocab(counting.token_counts(side_tokens(spark, sf)), min_freq, max_size)


def pair_ids(spark, sf, vocab: DataFrame | None = None) -> DataFrame:
    """Encoded pairs with boundaries; nothing is filtered."""
    vocab = vocab or side_vocab(spark, sf)
    tokens = pair_tokens(spark, sf)
    numbered = encoding.numericalize(tokens, vocab.filter("lang = 'src'"), "src_tokens", out="src_ids")
    numbered = encoding.numericalize(numbered, vocab.filter("lang = 'tgt'"), "tgt_tokens", out="tgt_ids")
    return numbered.select(
        "pair_id",
        idf.add_boundaries("src_ids", counting.SOS, counting.EOS).alias("src_ids"),
        idf.add_boundaries("tgt_ids", counting.SOS, counting.EOS).alias("tgt_ids"),
    )


def hypotheses(spark, sf) -> DataFrame:
    """Assistant turns with every seventh token taken out, beside the full text."""
    tokens = F.filter(F.split("tgt", " "), lambda t, i: i % 7 != 3)
    return bitext(spark, sf).select(
        F.col("pair_id").alias("sent_id"), F.array_join(tokens, " ").alias("hyp"), F.col("tgt").alias("ref")
    )


def word_vectors(spark, sf, vocab: DataFrame | None = None) -> DataFrame:
    """The embeddings as vectors of the words ranked first in the English documents."""
    table = load(spark, sf, "embeddings").select(
        (F.col("vec_id") + 4).alias("id"), F.col("vec_id").alias("line_no"), F.col("embedding").alias("vector")
    )
    vocab = vocab or english_vocab(spark, sf)
    return table.join(vocab.select("id", "token"), "id").select("line_no", "token", "vector")


def english_vocab(spark, sf) -> DataFrame:
    english = documents(spark, sf).filter("lang = 'en'").select("lang", tx.tokenize_ws("text").alias("tokens"))
    return counting.build_vocab(counting.token_counts(english), 5, 5000)


def batch_log(spark, sf) -> DataFrame:
    """Events as losses: a run per event type, an epoch per day, a batch per event."""
    return load(spark, sf, "events").select(
        F.col("event_type").alias("run_id"), F.dayofmonth("ts").cast("long").alias("epoch"), F.col("value").alias("loss")
    )


_models: dict = {}


def bpe_trained(spark, sf) -> bpe.BpeModel:
    """A model of the bitext, trained once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        _models[key] = bpe.train_bpe(files.corpus_lines(bitext(spark, sf)), BPE_SIZE)
    return _models[key]


def joined(ids: Column | str) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def micro(vector: Column | str) -> Column:
    return F.array_join(
        F.transform(vector, lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string")), ","
    )


# ---- sources and sinks ----------------------------------------------------


def read_bitext_jsonl(spark, sf):
    path = new_path(spark, "pairs")
    files.write_bitext_jsonl(bitext(spark, sf), path)
    return files.read_bitext_jsonl(spark, path).select("src", "tgt")


def read_rejects(spark, sf):
    """Every pair once whole and once cut off; the cut lines must be rejected."""
    path = new_path(spark, "broken")
    whole = bitext(spark, sf).select(F.to_json(F.struct(F.col("src").alias("zh"), F.col("tgt").alias("en"))).alias("line"))
    cut = whole.select(F.expr("substring(line, 1, length(line) - 1)").alias("line"))
    files.write_lines(whole.unionByName(cut), path)
    kept = files.read_bitext_jsonl(spark, path).agg(F.count("*").alias("n")).select(F.lit("kept").alias("outcome"), "n")
    lost = files.read_rejects(spark, path).agg(F.count("*").alias("n")).select(F.lit("rejected").alias("outcome"), "n")
    return kept.unionByName(lost)


def read_splits(spark, sf):
    pairs = bitext(spark, sf).withColumn("split", split_of(F.col("pair_id")))
    paths = {name: new_path(spark, name) for name in ("train", "validation", "test")}
    for name, path in paths.items():
        files.write_bitext_jsonl(pairs.filter(F.col("split") == name), path)
    return files.read_splits(spark, paths).select("split", "src", "tgt")


def corpus_lines(spark, sf):
    return files.corpus_lines(bitext(spark, sf))


def text_sink(spark, sf):
    path = new_path(spark, "lines")
    files.write_lines(files.corpus_lines(bitext(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def save_vocab(spark, sf):
    path = new_path(spark, "vocab")
    files.save_vocab(side_vocab(spark, sf), path)
    return files.load_vocab(spark, path)


def vocab_json(spark, sf):
    path = new_path(spark, "vocab-json")
    files.export_vocab_json(side_vocab(spark, sf).filter("lang = 'src'"), "src", path)
    return files.import_vocab_json(spark, path).select("lang", "id", "token")


def read_word_vectors(spark, sf):
    path = new_path(spark, "vectors")
    numbers = F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")
    files.write_lines(word_vectors(spark, sf).select(F.concat_ws(" ", "token", numbers).alias("line")), path)
    return files.read_word_vectors(spark, path, 64).select("token", micro("vector").alias("vector"))


def vocab_file(spark, sf):
    path = new_path(spark, "vocab-file") + ".json"
    files.export_vocab_file(side_vocab(spark, sf).filter("lang = 'src'"), "src", path)
    return files.import_vocab_json(spark, path).select("lang", "id", "token")


def export_bpe(spark, sf):
    path = new_path(spark, "bpe-files")
    files.export_bpe(bpe_trained(spark, sf), path)
    return files.import_bpe(spark, f"{path}/vocab.json", f"{path}/merges.txt").merges


def save_bpe(spark, sf):
    path = new_path(spark, "bpe")
    files.save_bpe(bpe_trained(spark, sf), path)
    return files.import_bpe(spark, f"{path}/vocab.json", f"{path}/merges.txt").merges


def write_encoded(spark, sf):
    path = new_path(spark, "encoded")
    files.write_encoded(pair_ids(spark, sf).withColumn("split", split_of(F.col("pair_id"))), path)
    table = spark.read.parquet(path)
    return table.select("split", "pair_id", joined("src_ids").alias("src_ids"), joined("tgt_ids").alias("tgt_ids"))


def write_metrics(spark, sf):
    path = new_path(spark, "metrics")
    files.write_metrics(metrics.epoch_metrics(batch_log(spark, sf)), path)
    table = spark.read.schema("run_id string, epoch long, mean_loss double, n_batches long").json(path)
    return table.withColumn("mean_loss", F.round("mean_loss", 6))


# ---- scalar functions -----------------------------------------------------


def normalize_text(spark, sf):
    return documents(spark, sf).select("doc_id", tx.normalize_text("text").alias("text"))


def normalize_text_basic(spark, sf):
    return documents(spark, sf).select("doc_id", tx.normalize_text_basic("text").alias("text"))


def tokenize_ws(spark, sf):
    return doc_tokens(spark, sf).select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"))


def tokenize_ptb(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(tx.tokenize_ptb("text"), " ").alias("tokens"))


def tokenize_ptb_trained(spark, sf):
    """Sentence ends by a model that is trained on the documents."""
    ends = sentences.sentence_ends(sentences.train_sentence_model(documents(spark, sf), "text"))
    return documents(spark, sf).select("doc_id", F.array_join(tx.tokenize_ptb("text", ends), " ").alias("tokens"))


def abbreviation_scores(spark, sf):
    scores = sentences.abbreviation_scores(materialize(sentences.type_counts(documents(spark, sf), "text"), "word-types"))
    return scores.select("type", "stopped", "bare", F.round("score", 6).alias("score"))


def solid_han(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents without their spaces, letters and digits as Chinese characters, and their words with frequencies."""
    lower = spread(documents(spark, sf), "spread-documents").select("doc_id", F.lower("text").alias("text"))
    han = lower.select("doc_id", F.translate("text", LATIN, HAN).alias("text"))
    # a range, since a class of single characters is searched one by one
    words = han.select(F.lit("zh").alias("lang"), F.regexp_extract_all("text", F.lit(f"[{HAN[0]}-{HAN[-1]}]+"), F.lit(0)).alias("tokens"))
    dictionary = materialize(counting.token_counts(words).select(F.col("token").alias("word"), "freq"), "words")
    solid = F.regexp_replace("text", r"(?U)\s+", "")  # before the letters are Chinese, while most texts have a byte per character
    return lower.select("doc_id", F.translate(solid, LATIN, HAN).alias("line")), dictionary


def segment_zh(spark, sf):
    """All documents, cut with all their words."""
    solid, dictionary = solid_han(spark, sf)
    return segment.segment_zh(solid, dictionary, "line", max_words=0).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def segment_zh_unseen(spark, sf):
    """All documents, cut with the words that occur three times or more and a model of the others."""
    solid, words = solid_han(spark, sf)
    dictionary = words.filter("freq >= 3")
    model = train_unseen_words(solid, dictionary, "line", rounds=2)
    rows = segment.segment_zh(solid, dictionary, "line", max_words=0, unseen=model)
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def tokenize(spark, sf):
    rows = documents(spark, sf).select("doc_id", tx.tokenize("text", "lang", unsupported="ws").alias("tokens"))
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def tokenizer_argument(spark, sf):
    """A tokenizer of the user's choice per language."""
    chosen = {"en": tx.tokenize_ws, "fr": lambda c: F.split(tx.normalize_text(c), "[,.] *")}
    rows = documents(spark, sf).select("doc_id", tx.tokenize("text", "lang", chosen, unsupported="ws").alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", "|").alias("tokens"))


def seq_length(spark, sf):
    return pair_tokens(spark, sf).select(
        "pair_id", tx.seq_length("src_tokens").alias("src_len"), tx.seq_length("tgt_tokens").alias("tgt_len")
    )


def add_prefix(spark, sf):
    return bitext(spark, sf).select("pair_id", tx.add_prefix("src", PREFIX).alias("src"))


def add_boundaries(spark, sf):
    return pair_ids(spark, sf).select("pair_id", joined("src_ids").alias("src_ids"), joined("tgt_ids").alias("tgt_ids"))


def _content(col: str) -> Column:
    return F.slice(col, F.lit(2), F.size(col) - 2)


def truncate_ids(spark, sf):
    cut = idf.truncate_ids(_content("tgt_ids"), 32, counting.SOS, counting.EOS)
    return pair_ids(spark, sf).select("pair_id", joined(cut).alias("tgt_ids"))


def _padded(spark, sf) -> DataFrame:
    return batching.pad_batch(batching.make_batches(pair_ids(spark, sf), 16), counting.PAD)


def mask_labels(spark, sf):
    return _padded(spark, sf).select("pair_id", joined(idf.mask_labels("tgt_padded", counting.PAD)).alias("labels"))


def unmask_labels(spark, sf):
    masked = idf.mask_labels("tgt_padded", counting.PAD)
    return _padded(spark, sf).select("pair_id", joined(idf.unmask_labels(masked, counting.PAD)).alias("ids"))


def shift_targets(spark, sf):
    shifted = idf.shift_targets("tgt_ids")
    return pair_ids(spark, sf).select(
        "pair_id", joined(shifted["tgt_in"]).alias("tgt_in"), joined(shifted["tgt_out"]).alias("tgt_out")
    )


def pad_mask(spark, sf):
    mask = F.transform(idf.pad_mask("src_padded", counting.PAD), lambda x: x.cast("int"))
    return _padded(spark, sf).select("pair_id", joined(mask).alias("mask"))


def strip_generated(spark, sf):
    """Generated ids: padded targets with noise after the closing boundary."""
    noisy = F.concat("tgt_padded", F.array(F.lit(7), F.lit(2), F.lit(9)))
    stripped = idf.strip_generated(noisy, counting.SOS, counting.EOS, counting.PAD)
    return _padded(spark, sf).select("pair_id", joined(stripped).alias("ids"))


def detokenize(spark, sf):
    return documents(spark, sf).select("doc_id", tx.detokenize(tx.tokenize_ptb("text")).alias("text"))


def bpe_encode(spark, sf):
    rows = bpe.bpe_encode(documents(spark, sf), bpe_trained(spark, sf), "text", mode="keep")
    return rows.select("doc_id", joined("ids").alias("ids"))


def bpe_encode_truncated(spark, sf):
    rows = bpe.bpe_encode(bitext(spark, sf), bpe_trained(spark, sf), "src", 128)
    return rows.select("pair_id", joined("ids").alias("ids"))


def bpe_decode(spark, sf):
    """Documents encoded and decoded; byte-level BPE gives the text back."""
    model = bpe_trained(spark, sf)
    rows = bpe.bpe_encode(documents(spark, sf).drop("lang"), model, "text", mode="keep").drop("text")
    return bpe.bpe_decode(rows, model).select("doc_id", "text")


def lookup_tokens(spark, sf):
    vocab = side_vocab(spark, sf)
    rows = encoding.lookup_tokens(pair_ids(spark, sf, vocab), vocab.filter("lang = 'src'"), "src_ids")
    return rows.select("pair_id", F.array_join("tokens", " ").alias("tokens"))


def lookup_tokens_joined(spark, sf):
    """The shuffle route for vocabularies beyond the broadcast bound."""
    vocab = side_vocab(spark, sf)
    ids = pair_ids(spark, sf, vocab)
    rows = encoding.lookup_tokens(ids, vocab.filter("lang = 'src'"), "src_ids", broadcast_entries=10)
    return rows.select("pair_id", F.array_join("tokens", " ").alias("tokens"))


# ---- filters --------------------------------------------------------------


def filter_by_length(spark, sf):
    return lengths.filter_by_length(pair_tokens(spark, sf), 128).select("pair_id", F.size("tgt_tokens").alias("tgt_len"))


def filter_bpe_length(spark, sf):
    kept = lengths.filter_bpe_length(pair_ids(spark, sf), 64, "filter")
    return kept.select("pair_id", joined("tgt_ids").alias("tgt_ids"))


def truncate_bpe_length(spark, sf):
    cut = lengths.filter_bpe_length(pair_ids(spark, sf), 64, "truncate")
    return cut.select("pair_id", joined("tgt_ids").alias("tgt_ids"))


def bpe_lengths(spark, sf) -> DataFrame:
    """BPE lengths of both sides with their boundaries."""
    rows = bpe.bpe_encode(bitext(spark, sf), bpe_trained(spark, sf), "src", mode="keep", out="src_ids")
    rows = bpe.bpe_encode(rows, bpe_trained(spark, sf), "tgt", mode="keep", out="tgt_ids")
    return rows.select("pair_id", tx.seq_length("src_ids").alias("src_len"), tx.seq_length("tgt_ids").alias("tgt_len"))


def bpe_length_stats(spark, sf):
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_len").alias("len")) for s in ("src", "tgt")])
    rows = lengths.length_stats(bpe_lengths(spark, sf).select(F.inline(sides)), "len", ["side"])
    return rows.withColumn("mean", F.round("mean", 6))


def bpe_suggest_max_len(spark, sf):
    return lengths.suggest_max_len(bpe_lengths(spark, sf), "src_len", "tgt_len")


def length_filter_report(spark, sf):
    return lengths.length_filter_report(pair_tokens(spark, sf).withColumn("split", split_of(F.col("pair_id"))), 128)


def drop_blank_sources(spark, sf):
    """Turns with every text of at most 60 characters blanked first."""
    turns = load(spark, sf, "conversations")
    src = F.when(F.length("text") <= 60, F.lit(" \n ")).otherwise(F.col("text")).alias("src")
    return lengths.drop_blank_sources(turns.select("conv_id", "turn", src))


# ---- joins ----------------------------------------------------------------


def numericalize(spark, sf):
    vocab = english_vocab(spark, sf)
    rows = encoding.numericalize(doc_tokens(spark, sf), vocab, key="doc_id")
    return rows.select("doc_id", joined("ids").alias("ids"))


def numericalize_joined(spark, sf):
    vocab = english_vocab(spark, sf)
    rows = encoding.numericalize(doc_tokens(spark, sf), vocab, key="doc_id", broadcast_entries=10)
    return rows.select("doc_id", joined("ids").alias("ids"))


def align_vectors(spark, sf):
    vocab = english_vocab(spark, sf)
    rows = vectors.align_vectors(vocab, word_vectors(spark, sf, vocab), 64, seed=1)
    return rows.select("id", "token", "hit", micro("vector").alias("vector"))


def vector_hit_stats(spark, sf):
    vocab = english_vocab(spark, sf)
    rows = vectors.vector_hit_stats(vocab, word_vectors(spark, sf, vocab), 64)
    return rows.withColumn("hit_rate", F.round("hit_rate", 6))


def align_hyp_ref(spark, sf):
    both = hypotheses(spark, sf)
    return bleu.align_hyp_ref(both.select("sent_id", "hyp"), both.select("sent_id", "ref"))


def oov_report(spark, sf):
    counts = materialize(counting.token_counts(side_tokens(spark, sf)), "counts")
    rows = counting.oov_report(counts, counting.build_vocab(counts, 2, 2000))
    return rows.withColumn("oov_rate", F.round("oov_rate", 9))


# ---- aggregations ---------------------------------------------------------


def token_counts(spark, sf):
    return doc_counts(spark, sf)


def token_counts_first_seen(spark, sf):
    rows = counting.token_counts(doc_tokens(spark, sf), key="doc_id")
    return rows.withColumn("first_pos", F.col("first_pos").cast("long"))


def build_vocab(spark, sf):
    return counting.build_vocab(doc_counts(spark, sf), 5, 25000)


def build_vocab_first_seen(spark, sf):
    return counting.build_vocab(counting.token_counts(doc_tokens(spark, sf), key="doc_id"), tie="first_seen")


def vocab_stats(spark, sf):
    counts = materialize(doc_counts(spark, sf), "counts")
    rows = counting.vocab_stats(counts, counting.build_vocab(counts, 5, 25000))
    return rows.withColumn("type_coverage", F.round("type_coverage", 9))


def vocabulary_totals(spark, sf):
    return coverage.vocabulary_totals(doc_counts(spark, sf))


def coverage_size(spark, sf):
    return coverage.coverage_size(doc_counts(spark, sf))


def min_freq_sweep(spark, sf):
    return coverage.min_freq_sweep(doc_counts(spark, sf)).withColumn("token_coverage", F.round("token_coverage", 9))


def top_tokens(spark, sf):
    return counting.top_tokens(doc_counts(spark, sf), 20)


def _doc_lengths(spark, sf) -> DataFrame:
    return doc_tokens(spark, sf).select("lang", F.size("tokens").alias("len"))


def length_stats(spark, sf):
    return lengths.length_stats(_doc_lengths(spark, sf), "len", ["lang"]).withColumn("mean", F.round("mean", 6))


def length_stats_approx(spark, sf):
    rows = lengths.length_stats(_doc_lengths(spark, sf), "len", ["lang"], exact=False)
    return rows.withColumn("mean", F.round("mean", 6))


def length_sketches(spark, sf):
    """Length reports of languages, and of all, from one summary for each language and source."""
    rows = load(spark, sf, "documents").select("lang", "source", tx.seq_length(tx.tokenize_ws("text")).alias("len"))
    parts = materialize(sketches.length_summary(rows, "len", ["lang", "source"]), "length-summaries")
    own = sketches.length_report(sketches.merge_length_summaries(parts, ["lang"]), ["lang"])
    whole = sketches.length_report(sketches.merge_length_summaries(parts)).withColumn("lang", F.lit("all"))
    return own.unionByName(whole)


def frequent_tokens(spark, sf):
    """Frequent tokens of each language from summaries of a bounded number of counters."""
    parts = sketches.token_summary(doc_tokens(spark, sf), by=["lang"])
    return sketches.frequent_tokens(parts, 20, ["lang"])


def length_histogram(spark, sf):
    rows = lengths.length_histogram(_doc_lengths(spark, sf), "len", 50, ["lang"])
    return rows.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


def length_kde(spark, sf):
    rows = lengths.length_kde(_doc_lengths(spark, sf), "len", 200, ["lang"])
    return rows.withColumns({"x": F.round("x", 6), "density": F.round("density", 9)})


def suggest_max_len(spark, sf):
    sizes = pair_tokens(spark, sf).select(F.size("src_tokens").alias("s"), F.size("tgt_tokens").alias("t"))
    return lengths.suggest_max_len(sizes, "s", "t")


def _rounded_bleu(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in ("score", "bp", "p1", "p2", "p3", "p4")})


def corpus_bleu(spark, sf):
    return _rounded_bleu(bleu.corpus_bleu(hypotheses(spark, sf)))


def corpus_bleu_by_split(spark, sf):
    pairs = hypotheses(spark, sf).withColumn("split", split_of(F.col("sent_id")))
    return _rounded_bleu(bleu.corpus_bleu(pairs, ["split"]))


def word_evaluation(spark, sf):
    """Generated target ids, with noise after the end, back to text and scored against the raw references."""
    vocab = side_vocab(spark, sf)
    generated = F.concat("tgt_ids", F.array(*[F.lit(i) for i in (7, counting.EOS, 9, counting.PAD)]))
    ids = idf.strip_generated(generated, counting.SOS, counting.EOS, counting.PAD)
    rows = pair_ids(spark, sf, vocab).select("pair_id", ids.alias("ids"))
    words = encoding.lookup_tokens(rows, vocab.filter("lang = 'tgt'"), "ids")
    hyps = words.select(F.col("pair_id").alias("sent_id"), tx.detokenize("tokens").alias("hyp"))
    refs = bitext(spark, sf).select(F.col("pair_id").alias("sent_id"), F.col("tgt").alias("ref"))
    return _rounded_bleu(bleu.corpus_bleu(bleu.align_hyp_ref(hyps, refs)))


def document_bleu(spark, sf):
    """BLEU of all documents against themselves without every seventh word, per language."""
    hyp = F.array_join(F.filter(F.split("text", " "), lambda t, i: i % 7 != 3), " ")
    pairs = documents(spark, sf).select(F.col("doc_id").alias("sent_id"), "lang", hyp.alias("hyp"), F.col("text").alias("ref"))
    return _rounded_bleu(bleu.corpus_bleu(pairs, ["lang"]))


def tokens_13a(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(tokenize_13a("text"), " ").alias("tokens"))


def train_bpe(spark, sf):
    return bpe_trained(spark, sf).merges


def pre_token_counts(spark, sf):
    return bpe.pre_token_counts(files.corpus_lines(bitext(spark, sf)))


def epoch_metrics(spark, sf):
    return metrics.epoch_metrics(batch_log(spark, sf)).withColumn("mean_loss", F.round("mean_loss", 6))


# ---- windows --------------------------------------------------------------


def coverage_curve(spark, sf):
    return coverage.coverage_curve(doc_counts(spark, sf)).withColumn("coverage", F.round("coverage", 9))


def coverage_view(spark, sf):
    """The plotted part of the curve."""
    rows = coverage.coverage_curve(doc_counts(spark, sf), coverage.CURVE_LIMIT)
    return rows.select("lang", "rank", F.round("coverage", 9).alias("coverage"))


def rank_frequency(spark, sf):
    rows = coverage.rank_frequency(doc_counts(spark, sf))
    return rows.withColumns({"log_rank": F.round("log_rank", 9), "log_freq": F.round("log_freq", 9)})


def coverage_guides(spark, sf):
    return coverage.coverage_guides(doc_counts(spark, sf))


def _epoch_values(spark, sf) -> DataFrame:
    return metrics.epoch_metrics(batch_log(spark, sf)).select("run_id", "epoch", F.round("mean_loss", 6).alias("value"))


def running_best(spark, sf):
    return metrics.running_best(_epoch_values(spark, sf))


def best_epoch(spark, sf):
    return metrics.best_epoch(_epoch_values(spark, sf))


def make_batches(spark, sf):
    return batching.make_batches(documents(spark, sf).drop("lang"), 256, key="doc_id")


def make_batches_shuffled(spark, sf):
    return batching.make_batches(documents(spark, sf).drop("lang"), 256, shuffle=True, seed=7, key="doc_id")


def length_bucketed_batches(spark, sf):
    rows = doc_tokens(spark, sf).select("doc_id", F.size("tokens").alias("n"))
    return batching.length_bucketed_batches(rows, 16, 8, seed=3, length="n", key="doc_id")


def pad_batch(spark, sf):
    return _padded(spark, sf).select(
        "pair_id", "batch_id", joined("src_padded").alias("src_padded"), joined("tgt_padded").alias("tgt_padded"), "src_len"
    )


def padding_waste(spark, sf):
    rows = batching.padding_waste(batching.make_batches(pair_ids(spark, sf), 16))
    return rows.withColumn("waste", F.round("waste", 9))


def total_padding_waste(spark, sf):
    batches = batching.make_batches(pair_ids(spark, sf), 16)
    return batching.total_padding_waste(batching.padding_waste(batches)).withColumn("waste", F.round("waste", 9))


def topk_candidates(spark, sf):
    """Events as scored candidates of their user."""
    rows = load(spark, sf, "events").select(
        F.col("user_id").alias("pair_id"), F.col("event_id").alias("cand"), F.col("value").alias("score")
    )
    return selection.topk_candidates(rows, 4)


def repeated(spark, sf):
    return documents(spark, sf).select("doc_id", repeated_ngrams(F.split("text", r"\s+"), 2).alias("repeats"))


def sample_predictions(spark, sf):
    return selection.sample_predictions(hypotheses(spark, sf), 0.3, seed=5)


def first_prediction(spark, sf):
    return selection.first_prediction(hypotheses(spark, sf))


# ---- streams --------------------------------------------------------------


def _run(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def _pair_folder(spark, sf) -> str:
    path = new_path(spark, "stream-in")
    files.write_bitext_jsonl(bitext(spark, sf), path)
    return path


def stream_encode(spark, sf):
    vocab = side_vocab(spark, sf)
    sink, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    stream = jobs.stream_bitext(spark, _pair_folder(spark, sf))
    _run(jobs.stream_encode(stream, vocab.filter("lang = 'src'"), vocab.filter("lang = 'tgt'"), sink, state))
    rows = spark.read.parquet(sink)
    return rows.select("src", "tgt", joined("src_ids").alias("src_ids"), joined("tgt_ids").alias("tgt_ids"))


def stream_token_counts(spark, sf):
    sink, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    lines = files.corpus_lines(jobs.stream_bitext(spark, _pair_folder(spark, sf)).withColumn("pair_id", F.lit(0)))
    tokens = lines.select(F.col("side").alias("lang"), tx.tokenize_ws("line").alias("tokens"))
    _run(jobs.publish_counts(jobs.stream_token_counts(tokens), sink, state))
    table = spark.read.parquet(sink)
    return table.join(table.agg(F.max("batch").alias("batch")), "batch", "left_semi").select("lang", "token", "freq")


def stream_count_changes(spark, sf):
    """The same counts, of which each micro-batch stores what it has changed."""
    sink, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    lines = files.corpus_lines(jobs.stream_bitext(spark, _pair_folder(spark, sf)).withColumn("pair_id", F.lit(0)))
    tokens = lines.select(F.col("side").alias("lang"), tx.tokenize_ws("line").alias("tokens"))
    _run(jobs.publish_changes(jobs.stream_token_counts(tokens), sink, state))
    return jobs.read_published(spark, sink)


def stream_requests(spark, sf):
    sink, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    stream = jobs.stream_bitext(spark, _pair_folder(spark, sf)).select("src")
    requests = jobs.stream_requests(stream, PREFIX, bpe_trained(spark, sf))
    _run(requests.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state))
    return spark.read.parquet(sink).select("request", joined("ids").alias("ids"))


# ---- user hooks -----------------------------------------------------------


def map_batches(spark, sf):
    """Task prefix and word count, as a user's function on batches of rows."""

    def prepare(frame):
        frame["request"] = PREFIX + frame["src"]
        frame["n_words"] = frame["request"].str.split(" ").str.len()
        return frame[["pair_id", "request", "n_words"]]

    return hooks.map_batches(bitext(spark, sf), prepare, "pair_id long, request string, n_words long")


def register_metric(spark, sf):
    """BLEU of id sequences, registered by name; labels carry the ignored value."""
    model = bpe_trained(spark, sf)
    rows = hypotheses(spark, sf)
    rows = bpe.bpe_encode(bpe.bpe_encode(rows, model, "hyp", mode="keep", out="preds"), model, "ref", mode="keep", out="labels")
    hidden = F.concat("labels", F.array(F.lit(-100)))
    metrics.register_metric("bleu", metrics.bleu_metric(model))
    scored = metrics.compute_metric("bleu", rows.select("sent_id", "preds", hidden.alias("labels")))
    return _rounded_bleu(scored)


def register_metric_by(spark, sf):
    """The same for each split of the corpus."""
    model = bpe_trained(spark, sf)
    rows = hypotheses(spark, sf).withColumn("split", split_of(F.col("sent_id")))
    rows = bpe.bpe_encode(bpe.bpe_encode(rows, model, "hyp", mode="keep", out="preds"), model, "ref", mode="keep", out="labels")
    metrics.register_metric("bleu", metrics.bleu_metric(model))
    return _rounded_bleu(metrics.compute_metric("bleu", rows.select("sent_id", "split", "preds", "labels"), ["split"]))


ALL = [
    read_bitext_jsonl, read_rejects, read_splits, corpus_lines, text_sink, save_vocab, vocab_json,
    read_word_vectors, save_bpe, write_encoded, write_metrics,
    normalize_text, normalize_text_basic, tokenize_ws, tokenize_ptb, tokenize_ptb_trained, abbreviation_scores, segment_zh, segment_zh_unseen, tokenize,
    tokenizer_argument,
    seq_length, add_prefix, add_boundaries, truncate_ids, mask_labels, unmask_labels, shift_targets, pad_mask,
    strip_generated, detokenize, bpe_encode, bpe_encode_truncated, bpe_decode, lookup_tokens, lookup_tokens_joined,
    filter_by_length, filter_bpe_length, truncate_bpe_length, length_filter_report, drop_blank_sources,
    numericalize, numericalize_joined, align_vectors, vector_hit_stats, align_hyp_ref, oov_report,
    token_counts, token_counts_first_seen, build_vocab, build_vocab_first_seen, vocab_stats, vocabulary_totals,
    coverage_size, min_freq_sweep, top_tokens, length_stats, length_stats_approx, length_histogram, length_kde,
    suggest_max_len, corpus_bleu, corpus_bleu_by_split, word_evaluation, document_bleu, tokens_13a, train_bpe, pre_token_counts,
    epoch_metrics, coverage_curve, coverage_view, rank_frequency, coverage_guides, running_best, best_epoch,
    make_batches, make_batches_shuffled, length_bucketed_batches, pad_batch, padding_waste, total_padding_waste,
    topk_candidates, sample_predictions, first_prediction,
    stream_encode, stream_token_counts, stream_count_changes, stream_requests, map_batches, register_metric, register_metric_by,
    vocab_file, export_bpe, length_sketches, frequent_tokens, bpe_length_stats, bpe_suggest_max_len,
]

QUERIES = {fn.__name__: fn for fn in ALL} | {"repeated_ngrams": repeated}
