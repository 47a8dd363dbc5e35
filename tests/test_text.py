import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from bitloom.functions import text as tx
from bitloom.functions.ngrams import repeated_ngrams, tokenize_13a

SAMPLES = [
    "Ａ１　ｂ", "a\nb\tc", "zero​width", "  spaced out  ", "", None, "İΣ", "½ ﬁ …", "中文　句子。", "soft­hyphen", "é",
]


def clean(s):
    if not isinstance(s, str):
        return ""
    return "".join(ch for ch in unicodedata.normalize("NFKC", s) if ch.isprintable()).strip()


def column(spark, values, schema="t string"):
    return spark.createDataFrame([(v,) for v in values], schema).coalesce(1)


def test_normalize_text_matches_python(spark):
    rows = column(spark, SAMPLES).select(tx.normalize_text("t"), tx.normalize_text("t", once=True)).collect()
    assert [r[0] for r in rows] == [clean(s) for s in SAMPLES]
    assert [r[0] for r in rows] == [r[1] for r in rows]


def test_normalize_text_basic_equals_full_form_on_nfkc_text(spark):
    values = [clean(s) + "\n\x07" for s in SAMPLES]
    rows = column(spark, values).select(tx.normalize_text_basic("t")).collect()
    assert [r[0] for r in rows] == [clean(v) for v in values]


def test_tokenize_ws(spark):
    rows = column(spark, SAMPLES).select(tx.tokenize_ws("t")).collect()
    assert [r[0] for r in rows] == [clean(s).lower().split() for s in SAMPLES]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Good muffins cost $3.88 in New York.", "good muffins cost $ 3.88 in new york ."),
        ("They'll save, and I cannot wait!", "they 'll save , and i can not wait !"),
        ("don't (really) -- it's fine...", "do n't ( really ) -- it 's fine ..."),
        ('He said "hi".', "he said `` hi '' ."),
        ("gonna wanna go", "gon na wan na go"),
        ("Hello there. How are you? Fine. I left.", "hello there . how are you ? fine . i left ."),
        ("Dr. Smith met J. Doe. They left, e.g. by car.", "dr. smith met j. doe . they left , e.g. by car ."),
        ('He said "stop." Then it cost 3.5. (We paid.) Done.', "he said `` stop . '' then it cost 3.5. ( we paid . ) done ."),
        ("Er ist verwüst. Ja.", "er ist verwüst . ja ."),
        ("It isn't. We'll see...", "it is n't . we 'll see ..."),
    ],
)
def test_tokenize_ptb(spark, text, tokens):
    assert column(spark, [text]).select(tx.tokenize_ptb("t")).first()[0] == tokens.split()


# the published rules one after the other, with the rule for the ends of inner sentences
ONE_BY_ONE = [
    (r"([«“‘„]|[`]+)", r" $1 "),
    (r"^\"", r"``"),
    (r"(``)", r" $1 "),
    (r"([ \(\[{<])(\"|'{2})", r"$1 `` "),
    (r"(?iU)(')(?!re|ve|ll|m|t|s|d|n)(\w)\b", r"$1 $2"),
    (rf"(?<=[^\s.]{{2}})(?<!(?<![\p{{L}}\p{{N}}])(?:{'|'.join(tx.ABBREVIATIONS)}))(\.)([\]\)}}>\"'»”’]*)(?=\s)", r" $1 $2"),
    (r"([^\.])(\.)([\]\)}>\"'»”’ ]*)\s*$", r"$1 $2 $3 "),
    (r"([:,])([^\d])", r" $1 $2"),
    (r"([:,])$", r" $1 "),
    (r"(\.{2,})", r" $1 "),
    (r"([;@#$%&])", r" $1 "),
    (r"([?!])", r" $1 "),
    (r"([^'])' ", r"$1 ' "),
    (r"([*])", r" $1 "),
    (r"([\]\[\(\)\{\}<>])", r" $1 "),
    (r"--", r" -- "),
    (r"^(.*)$", r" $1 "),
    (r"([»”’])", r" $1 "),
    (r"''", r" '' "),
    (r"\"", r" '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"$1 $2 "),
    *[(rf"(?iU)\b({a})({b})\b", r" $1 $2 ") for a, b in map(str.split, ("can not", "d 'ye", "gim me", "gon na", "got ta", "lem me", "more 'n"))],
    (r"(?iU)\b(wan)(na)(?=\s)", r" $1 $2 "),
    (r"(?iU) ('t)(is)\b", r" $1 $2 "),
    (r"(?iU) ('t)(was)\b", r" $1 $2 "),
]


def test_ptb_passes_give_what_the_rules_give_one_by_one(spark):
    rng = random.Random(5)
    parts = list("'\"`«“‘„»”’.,:;@#$%&?!*()[]{}<>-_ab9 ''.. ,") + "'' `` -- .. n't 's 'll 're 've 'd 'm mr e.g. ab é etc".split()
    parts += "cannot d'ye gimme gonna gotta lemme more'n wanna 'tis 'twas gımme".split() + ["\u0301", "\U0001f600"]
    texts = {"".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(20_000)}
    texts |= {"".join(x) for x in itertools.product("'\" .,(a", repeat=4)}
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "t string").repartition(4)
    stops = lambda c: F.regexp_replace(c, r"(\w)\.(\S*) ", r"$1 . $2 ")
    text = F.lower(tx.normalize_text("t"))
    at = 5  # the ends of inner sentences
    known = tx._words(tx._chain(text, ONE_BY_ONE))
    given = tx._words(tx._chain(stops(tx._chain(text, ONE_BY_ONE[:at])), ONE_BY_ONE[at + 1 :]))
    both = rows.select("t", tx.tokenize_ptb("t").alias("a"), known.alias("b"), tx.tokenize_ptb("t", stops).alias("c"), given.alias("d"))
    assert both.filter("a <> b or c <> d").collect() == []


def test_ptb_looks_at_a_text_in_few_passes(spark):
    plan = column(spark, ["a"]).select(tx.tokenize_ptb("t").alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_replace(") <= 10


def test_detokenize_reattaches_punctuation(spark):
    tokens = "they 'll save ( a lot ) , and i can not wait ! it 's 5 % off .".split()
    row = column(spark, [tokens], "t array<string>").select(tx.detokenize("t")).first()
    assert row[0] == "they'll save (a lot), and i cannot wait! it's 5% off."


def test_tokenize_dispatch(spark):
    df = spark.createDataFrame([("A b", "en"), ("C d", "de")], "t string, lang string")
    assert [r[0] for r in df.select(tx.tokenize("t", "lang", unsupported="ws")).collect()] == [["a", "b"], ["c", "d"]]
    chosen = {"en": tx.tokenize_ws, "de": lambda c: F.split(c, "")}
    assert df.select(tx.tokenize("t", "lang", chosen)).collect()[1][0] == ["C", " ", "d"]
    with pytest.raises(Exception, match="Unsupported language: de"):
        df.select(tx.tokenize("t", "lang")).collect()


def test_prefix_and_length(spark):
    df = spark.createDataFrame([("x", ["a", "b"]), ("y", None)], "t string, k array<string>")
    rows = df.select(tx.add_prefix("t", "go: "), tx.seq_length("k")).collect()
    assert [tuple(r) for r in rows] == [("go: x", 2), ("go: y", 0)]


def test_tokenize_13a(spark):
    text = "A &quot;test&quot; &amp; more, 3.14 5-6 x-y end-\nline.  "
    expected = ["A", '"', "test", '"', "&", "more", ",", "3.14", "5", "-", "6", "x-y", "endline", "."]
    assert column(spark, [text]).select(tokenize_13a("t")).first()[0] == expected


def test_repeated_ngrams(spark):
    values = [["a", "b", "a", "b"], ["a", "b", "c"], ["a"], [], ["a", "a"]]
    rows = column(spark, values, "t array<string>").select(repeated_ngrams("t", 2), repeated_ngrams("t", 1)).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False), (False, False), (False, False), (False, True)]


def test_ascii_does_not_travel_to_python(spark, monkeypatch):
    from bitloom.functions import text

    def only_other(texts):
        assert not any(isinstance(t, str) and t.isascii() for t in texts)
        return text._clean_all(texts)

    monkeypatch.setattr(text, "_clean_udf", F.pandas_udf(only_other, "string"))
    texts = [" a\nb\tc\x00\x7f ", "\x1f x  y\r\n", "", None, "é\n", "".join(map(chr, range(128)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("n", text.normalize_text("t"))
    assert {r.i: r.n for r in rows.collect()} == {i: text._clean(t or "") for i, t in enumerate(texts)}
