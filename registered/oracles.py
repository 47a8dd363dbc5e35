"""DuckDB SQL that gives the same result as each registered query.

Queries without an entry have no SQL form (byte-pair encoding, segmentation);
the tests compare those with brute force.
"""

from __future__ import annotations

from registered.queries import PREFIX


def norm(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\p{{C}}\p{{Zl}}\p{{Zp}}]', '', 'g'))"


def words(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda x: x <> '')"


def ws(text: str) -> str:
    return words(f"lower({norm(text)})")


def h60(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15))::BIGINT"


def micro(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',')"


def text_list(ids: str) -> str:
    return f"array_to_string({ids}, ',')"


# The published Treebank rules, in RE2 form (no look-around).
PTB = [
    (r"([«“‘„]|[`]+)", r" \1 "),
    (r"^\"", r"``"),
    (r"(``)", r" \1 "),
    (r"([ \(\[{<])(\"|'{2})", r"\1 `` "),
    (r"(')([^\WmtsdnMTSDN])\b", r"\1 \2"),
    # the ends of inner sentences: hide the stops of abbreviations, part the others, show them again
    (r"(^|[^\pL\pN])(mr|mrs|ms|dr|prof|st|vs|jr|sr|etc|fig|inc)\.([\]\)}>\"'»”’]*\s)", "\\1\\2\x01\\3"),
    (r"([^\s.][^\s.])(\.)([\]\)}>\"'»”’]*)(\s)", r"\1 \2 \3\4"),
    ("\x01", "."),
    (r"([^\.])(\.)([\]\)}>\"'»”’ ]*)\s*$", r"\1 \2 \3 "),
    (r"([:,])([^\d])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"(\.{2,})", r" \1 "),
    (r"([;@#$%&])", r" \1 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"([*])", r" \1 "),
    (r"([\]\[\(\)\{\}<>])", r" \1 "),
    (r"--", r" -- "),
    (r"^(.*)$", r" \1 "),
    (r"([»”’])", r" \1 "),
    (r"''", r" '' "),
    (r"\"", r" '' "),
    (r"([^' ])('s|'m|'d|') ", r"\1 \2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", r"\1 \2 "),
    (r"\b(can)(not)\b", r" \1 \2 "),
    (r"\b(d)('ye)\b", r" \1 \2 "),
    (r"\b(gim)(me)\b", r" \1 \2 "),
    (r"\b(gon)(na)\b", r" \1 \2 "),
    (r"\b(got)(ta)\b", r" \1 \2 "),
    (r"\b(lem)(me)\b", r" \1 \2 "),
    (r"\b(more)('n)\b", r" \1 \2 "),
    (r"\b(wan)(na)(\s)", r" \1 \2 \3"),
    (r" ('t)(is)\b", r" \1 \2 "),
    (r" ('t)(was)\b", r" \1 \2 "),
]
UNPTB = [
    (r"( 't)\s(is|was)\b", r"\1\2"),
    (r"\b(can)\s(not)\b", r"\1\2"),
    (r"\b(d)\s('ye)\b", r"\1\2"),
    (r"\b(gim|lem)\s(me)\b", r"\1\2"),
    (r"\b(gon|wan)\s(na)\b", r"\1\2"),
    (r"\b(got)\s(ta)\b", r"\1\2"),
    (r"\b(more)\s('n)\b", r"\1\2"),
    (r"([^' ])\s('ll|'re|'ve|n't) ", r"\1\2 "),
    (r"([^' ])\s('s|'m|'d|') ", r"\1\2 "),
    (r"(\S)\s('')", r"\1\2"),
    (r"('')\s([.,:)\]>};%])", r"\1\2"),
    (r"''", r'"'),
    (r"^\s+|\s+$", r""),
    (r" -- ", r"--"),
    (r"([\[\(\{<])\s", r"\1"),
    (r"\s([\]\)\}>])", r"\1"),
    (r"([\]\)\}>])\s([:;,.])", r"\1\2"),
    (r"([^'])\s'\s", r"\1' "),
    (r"\s([?!])", r"\1"),
    (r"([^\.])\s(\.)([\]\)}>\"']*)\s*$", r"\1\2\3"),
    (r"([#$])\s", r"\1"),
    (r"\s([;%])", r"\1"),
    (r"\s([&*])\s", r" \1 "),
    (r"\s\.\.\.\s", r"..."),
    (r"\s([:,])\s", r"\1 "),
    (r"([ (\[{<])\s``", r"\1``"),
    (r"(``)\s", r"\1"),
    (r"``", r'"'),
]


def chain(text: str, rules: list[tuple[str, str]]) -> str:
    for rule in rules:
        pattern, replacement = (part.replace("'", "''") for part in rule)
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


def ptb(text: str) -> str:
    return words(chain(f"lower({norm(text)})", PTB))


def unptb(tokens: str) -> str:
    return f"trim({chain(f"' ' || array_to_string({tokens}, ' ') || ' '", UNPTB)})"


def t13a(text: str) -> str:
    plain = rf"regexp_replace({text}, '\s+$', '')"
    plain = f"replace(replace(replace({plain}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, ch in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        plain = f"replace({plain}, '{entity}', '{ch}')"
    plain = f"' ' || {plain} || ' '"
    for pattern, repl in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        plain = f"regexp_replace({plain}, '{pattern}', '{repl}', 'g')"
    return rf"list_filter(string_split_regex({plain}, '\s+'), lambda x: x <> '')"


def split_of(pair_id: str) -> str:
    digit = f"(({pair_id} >> 32) % 10)"
    return f"CASE {digit} WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def vocab(counts: str, min_freq: int, max_size: int | None, order: str = "token") -> str:
    top = "" if max_size is None else f"WHERE rn <= {max_size - 4}"
    return f"""(
      SELECT lang, s.id, s.token, CAST(0 AS BIGINT) AS freq
      FROM (SELECT DISTINCT lang FROM {counts}),
           (VALUES (0, '<pad>'), (1, '<sos>'), (2, '<eos>'), (3, '<unk>')) s(id, token)
      UNION ALL
      SELECT lang, CAST(rn + 3 AS INTEGER), token, freq FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, {order}) AS rn FROM {counts}
        WHERE freq >= {min_freq} AND token NOT IN ('<pad>', '<sos>', '<eos>', '<unk>')) {top})"""


DOCS = f"""WITH toks AS (SELECT doc_id, lang, {ws('text')} AS tokens FROM documents),
cnt AS (SELECT lang, token, count(*) AS freq FROM (SELECT lang, unnest(tokens) AS token FROM toks) GROUP BY 1, 2),
curve AS (SELECT lang, token, freq,
    row_number() OVER (PARTITION BY lang ORDER BY freq DESC, token) AS rank,
    CAST(sum(freq) OVER (PARTITION BY lang ORDER BY freq DESC, token ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
    CAST(sum(freq) OVER (PARTITION BY lang) AS BIGINT) AS total FROM cnt),
lens AS (SELECT lang, CAST(len(tokens) AS BIGINT) AS len FROM toks)
"""

PAIRS = f"""WITH pairs AS (
    SELECT CAST(u.conv_id AS BIGINT) * 4294967296 + u.turn AS pair_id, u.text AS src, a.text AS tgt
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'),
ptoks AS (SELECT pair_id, {ws('src')} AS src_tokens, {ws('tgt')} AS tgt_tokens FROM pairs),
ex AS (SELECT pair_id, 'src' AS lang, unnest(src_tokens) AS token, generate_subscripts(src_tokens, 1) AS pos FROM ptoks
       UNION ALL
       SELECT pair_id, 'tgt', unnest(tgt_tokens), generate_subscripts(tgt_tokens, 1) FROM ptoks),
cnt AS (SELECT lang, token, count(*) AS freq FROM ex GROUP BY 1, 2),
voc AS {vocab('cnt', 2, 2000)},
eid AS (SELECT pair_id, ex.lang, list(coalesce(v.id, 3) ORDER BY pos) AS ids,
               list(coalesce(v.token, '<unk>') ORDER BY pos) AS known
        FROM ex LEFT JOIN voc v ON v.lang = ex.lang AND v.token = ex.token GROUP BY 1, 2),
pids AS (SELECT p.pair_id, [1] || coalesce(s.ids, []) || [2] AS src_ids, [1] || coalesce(t.ids, []) || [2] AS tgt_ids,
                coalesce(s.known, []) AS src_known, coalesce(t.known, []) AS tgt_known
         FROM pairs p LEFT JOIN eid s ON s.pair_id = p.pair_id AND s.lang = 'src'
                      LEFT JOIN eid t ON t.pair_id = p.pair_id AND t.lang = 'tgt'),
bat AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch_id FROM pids),
pad AS (SELECT *, list_resize(src_ids, max(len(src_ids)) OVER (PARTITION BY batch_id), 0) AS src_padded,
                  list_resize(tgt_ids, max(len(tgt_ids)) OVER (PARTITION BY batch_id), 0) AS tgt_padded FROM bat)
"""

HYP = PAIRS + """, hyps AS (SELECT pair_id AS sent_id,
    array_to_string(list_filter(string_split(tgt, ' '), lambda t, i: (i - 1) % 7 <> 3), ' ') AS hyp, tgt AS ref FROM pairs)
"""

ENGLISH = DOCS + f""", ecnt AS (SELECT * FROM cnt WHERE lang = 'en'),
voc AS {vocab('ecnt', 5, 5000)},
vecs AS (SELECT v.token, e.embedding, e.vec_id AS line_no FROM embeddings e JOIN voc v ON v.id = e.vec_id + 4)
"""

LOG = """WITH log AS (SELECT event_type AS run_id, CAST(dayofmonth(ts) AS BIGINT) AS epoch, value AS loss FROM events),
epochs AS (SELECT run_id, epoch, round(avg(loss), 6) AS mean_loss, count(*) AS n_batches FROM log GROUP BY 1, 2)
"""


def bleu(base: str, table: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    on = f"AND h.{by} = r.{by}" if by else ""
    sides = []
    for side in ("hyp", "ref"):
        grams = " UNION ALL ".join(
            f"SELECT sent_id, {group}{n} AS n, unnest(list_transform(range(1, len(t) - {n - 2}), "
            f"lambda i: array_to_string(t[i:i+{n - 1}], ' '))) AS gram FROM {side}_t"
            for n in range(1, 5)
        )
        sides.append(
            f"{side}_t AS (SELECT sent_id, {group}{t13a(side)} AS t FROM {table}),"
            f"{side}_g AS (SELECT sent_id, {group}n, gram, count(*) AS c FROM ({grams}) GROUP BY ALL)"
        )
    groups = f"SELECT DISTINCT {by} FROM {table}" if by else "SELECT 1 AS one"

    def at(source: str, expr: str) -> str:
        where = f"WHERE {source}.{by} = g.{by}" if by else ""
        return f"(SELECT coalesce(sum({expr}), 0) FROM {source} {where})"

    match = (
        f"matched AS (SELECT h.n, {'h.' + by + ', ' if by else ''}least(h.c, r.c) AS m FROM hyp_g h JOIN ref_g r "
        f"ON h.sent_id = r.sent_id AND h.n = r.n AND h.gram = r.gram {on})"
    )
    cols = []
    for n in range(1, 5):
        cols.append(at("matched", f"CASE WHEN n = {n} THEN m ELSE 0 END") + f" AS c{n}")
        cols.append(at("hyp_g", f"CASE WHEN n = {n} THEN c ELSE 0 END") + f" AS t{n}")
    cols.append(at("ref_g", "CASE WHEN n = 1 THEN c ELSE 0 END") + " AS rl")
    ps = []
    for n in range(1, 5):
        k = " + ".join(f"CASE WHEN c{j} = 0 AND t{j} > 0 THEN 1 ELSE 0 END" for j in range(1, n + 1))
        ps.append(
            f"CASE WHEN t{n} = 0 THEN 0.0 WHEN c{n} = 0 THEN 100.0::DOUBLE / (pow(2.0, {k}) * t{n}) "
            f"ELSE 100.0::DOUBLE * c{n} / t{n} END AS p{n}"
        )
    return f"""{base}, {', '.join(sides)}, {match},
    sums AS (SELECT g.*, {', '.join(cols)} FROM ({groups}) g),
    parts AS (SELECT *, {', '.join(ps)},
        CASE WHEN t1 >= rl THEN 1.0::DOUBLE WHEN t1 = 0 THEN 0.0 ELSE exp(1 - rl::DOUBLE / t1) END AS bp FROM sums)
    SELECT {group}round(CASE WHEN c1 + c2 + c3 + c4 > 0 AND least(p1, p2, p3, p4) > 0
        THEN bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0 END, 6) AS score, round(bp, 6) AS bp,
        CAST(t1 AS BIGINT) AS hyp_len, CAST(rl AS BIGINT) AS ref_len,
        round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4"""


SPLIT = split_of("pair_id")
TWO_LINES = "SELECT pair_id, 'src' AS side, src AS line FROM pairs UNION ALL SELECT pair_id, 'tgt', tgt FROM pairs"
IDS = f"{text_list('src_ids')} AS src_ids, {text_list('tgt_ids')} AS tgt_ids"
PERCENTILES = ", ".join(
    f"CAST(trunc(quantile_cont(len, {p})) AS BIGINT) AS {name}"
    for name, p in {"p90": 0.9, "p95": 0.95, "p98": 0.98, "p99": 0.99, "p995": 0.995, "p999": 0.999}.items()
)
NUMBERED = f"""{ENGLISH}, dex AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM toks),
num AS (SELECT doc_id, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ',' ORDER BY pos) AS ids
        FROM dex LEFT JOIN voc v ON v.token = dex.token GROUP BY 1)
SELECT d.doc_id, coalesce(num.ids, '') AS ids FROM documents d LEFT JOIN num ON num.doc_id = d.doc_id"""


def mixed(source: str, value: str, out: str) -> str:
    """Five steps of 31-bit mixing, a subquery each."""
    steps = f"SELECT *, xor(x0, x0 >> 15) AS x1 FROM (SELECT *, ({value})::BIGINT AS x0 FROM {source})"
    steps = f"SELECT *, (x1 * 739982445) & 2147483647 AS x2 FROM ({steps})"
    steps = f"SELECT *, (xor(x2, x2 >> 12) * 695872825) & 2147483647 AS x3 FROM ({steps})"
    return f"SELECT * EXCLUDE (x0, x1, x2, x3), xor(x3, x3 >> 15) AS {out} FROM ({steps})"


NOISE = f"""m1 AS ({mixed('voc', '1', 'a1')}), m2 AS ({mixed('m1', 'xor(a1, id & 2147483647)', 'a2')}),
m3 AS ({mixed('m2', 'xor(a2, (id::BIGINT >> 31) & 2147483647)', 'a3')}),
m4 AS ({mixed('(SELECT id, a3, unnest(range(64)) AS d FROM m3)', 'xor(a3, d)', 'u')}),
pairs_of AS (
    SELECT id, d // 2 AS p, sqrt(-2 * ln((max(u) FILTER (d % 2 = 0) + 1)::DOUBLE / 2147483648.0)) AS r,
        2 * pi() * (max(u) FILTER (d % 2 = 1)::DOUBLE / 2147483648.0) AS t
    FROM m4 GROUP BY 1, 2
), noises AS (SELECT id, flatten(list([0.6 * (r * cos(t)), 0.6 * (r * sin(t))] ORDER BY p)) AS noise FROM pairs_of GROUP BY 1)"""
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+""".replace("'", "''")
KNOWN = f"""{PAIRS} SELECT pair_id, '<sos> ' || array_to_string(src_known, ' ') ||
    CASE WHEN len(src_known) > 0 THEN ' ' ELSE '' END || '<eos>' AS tokens FROM pids"""
LENGTH_STATS = f"""{DOCS} SELECT lang, count(*) AS n, min(len) AS min, max(len) AS max, round(avg(len), 6) AS mean,
    quantile_cont(len, 0.5) AS median, {PERCENTILES} FROM lens GROUP BY 1"""
BATCHED = "CAST(floor((rn - 1) / 256) AS BIGINT) AS batch_id, CAST((rn - 1) % 256 AS INTEGER) AS pos_in_batch"

ORACLES: dict[str, str] = {
    "read_bitext_jsonl": f"{PAIRS} SELECT src, tgt FROM pairs",
    "read_rejects": f"""{PAIRS} SELECT 'kept' AS outcome, count(*) AS n FROM pairs
        UNION ALL SELECT 'rejected', count(*) FROM pairs""",
    "read_splits": f"{PAIRS} SELECT {SPLIT} AS split, src, tgt FROM pairs",
    "corpus_lines": f"{PAIRS} {TWO_LINES}",
    "text_sink": f"{PAIRS} SELECT unnest(string_split(line, chr(10))) AS line FROM ({TWO_LINES})",
    "save_vocab": f"{PAIRS} SELECT lang, id, token, freq FROM voc",
    "vocab_json": f"{PAIRS} SELECT lang, id, token FROM voc WHERE lang = 'src'",
    "vocab_file": f"{PAIRS} SELECT lang, id, token FROM voc WHERE lang = 'src'",
    "read_word_vectors": f"{ENGLISH} SELECT token, {micro('embedding')} AS vector FROM vecs",
    "write_encoded": f"{PAIRS} SELECT {SPLIT} AS split, pair_id, {IDS} FROM pids",
    "write_metrics": f"{LOG} SELECT * FROM epochs",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS text FROM documents",
    "normalize_text_basic": f"SELECT doc_id, {norm('text')} AS text FROM documents",
    "tokenize_ws": f"{DOCS} SELECT doc_id, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS INTEGER) AS n FROM toks",
    "abbreviation_scores": r"""
WITH words AS (
    SELECT unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}](?:[\p{L}\p{N}.''’\-]*[\p{L}\p{N}])?\.*|[?!]+')) AS word FROM documents
), types AS (
    SELECT lower(regexp_replace(word, '\.+$', '')) AS type, count(*) FILTER (regexp_matches(word, '[^.]\.$')) AS stopped,
        count(*) FILTER (NOT regexp_matches(word, '[^.]\.$')) AS bare
    FROM words WHERE NOT regexp_matches(word, '^[?!]') GROUP BY 1
), total AS (SELECT sum(stopped + bare)::DOUBLE AS n, sum(stopped)::DOUBLE AS stops FROM types
), likely AS (
    SELECT type, stopped, bare, length(replace(type, '.', '')) AS letters,
        stopped * ln(stops / n) + bare * ln(1 - stops / n) AS plain, stopped * ln(0.99::DOUBLE) + bare * ln(1 - 0.99::DOUBLE) AS short
    FROM types, total WHERE stopped > 0 AND regexp_matches(type, '\p{L}')
)
SELECT type, stopped::BIGINT AS stopped, bare::BIGINT AS bare,
    round(-2 * (plain - short) * exp(-letters) * (length(type) - letters + 1) * pow(letters::DOUBLE, -bare::DOUBLE), 6) + 0 AS score
FROM likely
""",
    "tokenize_ptb": f"SELECT doc_id, array_to_string({ptb('text')}, ' ') AS tokens FROM documents",
    "tokenize": f"{DOCS} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM toks",
    "tokenizer_argument": f"""{DOCS}, chosen AS (SELECT doc_id, CASE WHEN d.lang = 'fr'
        THEN string_split_regex({norm('text')}, '[,.] *') ELSE tokens END AS t FROM documents d JOIN toks USING (doc_id))
        SELECT doc_id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, '|') AS tokens FROM chosen""",
    "seq_length": f"""{PAIRS} SELECT pair_id, CAST(len(src_tokens) AS INTEGER) AS src_len,
        CAST(len(tgt_tokens) AS INTEGER) AS tgt_len FROM ptoks""",
    "add_prefix": f"{PAIRS} SELECT pair_id, '{PREFIX}' || src AS src FROM pairs",
    "add_boundaries": f"{PAIRS} SELECT pair_id, {IDS} FROM pids",
    "truncate_ids": f"{PAIRS} SELECT pair_id, {text_list('tgt_ids[1:least(31, len(tgt_ids) - 1)] || [2]')} AS tgt_ids FROM pids",
    "mask_labels": f"""{PAIRS} SELECT pair_id,
        {text_list('list_transform(tgt_padded, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels FROM pad""",
    "unmask_labels": f"{PAIRS} SELECT pair_id, {text_list('tgt_padded')} AS ids FROM pad",
    "shift_targets": f"""{PAIRS} SELECT pair_id, {text_list('tgt_ids[1:len(tgt_ids) - 1]')} AS tgt_in,
        {text_list('tgt_ids[2:]')} AS tgt_out FROM pids""",
    "pad_mask": f"""{PAIRS} SELECT pair_id,
        {text_list('list_transform(src_padded, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END)')} AS mask FROM pad""",
    "strip_generated": f"{PAIRS} SELECT pair_id, {text_list('tgt_ids[2:len(tgt_ids) - 1]')} AS ids FROM pids",
    "detokenize": f"SELECT doc_id, {unptb(ptb('text'))} AS text FROM documents",
    "bpe_decode": "SELECT doc_id, text FROM documents",
    "lookup_tokens": KNOWN,
    "lookup_tokens_joined": KNOWN,
    "filter_by_length": f"""{PAIRS} SELECT pair_id, CAST(len(tgt_tokens) AS INTEGER) AS tgt_len FROM ptoks
        WHERE len(src_tokens) + 2 <= 128 AND len(tgt_tokens) + 2 <= 128""",
    "filter_bpe_length": f"""{PAIRS} SELECT pair_id, {text_list('tgt_ids')} AS tgt_ids FROM pids
        WHERE len(src_ids) <= 64 AND len(tgt_ids) <= 64""",
    "truncate_bpe_length": f"""{PAIRS} SELECT pair_id,
        {text_list('tgt_ids[1:least(63, len(tgt_ids) - 1)] || [2]')} AS tgt_ids FROM pids""",
    "length_filter_report": f"""{PAIRS} SELECT {SPLIT} AS split,
        count(*) FILTER (WHERE greatest(len(src_tokens), len(tgt_tokens)) + 2 <= 128) AS kept,
        count(*) FILTER (WHERE greatest(len(src_tokens), len(tgt_tokens)) + 2 > 128) AS ignored FROM ptoks GROUP BY 1""",
    "drop_blank_sources": "SELECT conv_id, turn, text AS src FROM conversations WHERE length(text) > 60",
    "numericalize": NUMBERED,
    "numericalize_joined": NUMBERED,
    "align_vectors": f"""{ENGLISH}, {NOISE} SELECT id, voc.token, vecs.token IS NOT NULL AS hit, {micro(f'''CASE WHEN id = 0
        THEN list_transform(range(0, 64), lambda d: 0.0::DOUBLE) WHEN vecs.token IS NOT NULL
        THEN list_transform(embedding, lambda x: x::DOUBLE) ELSE noise END''')} AS vector
        FROM voc JOIN noises USING (id) LEFT JOIN vecs ON vecs.token = voc.token""",
    "vector_hit_stats": f"""{ENGLISH} SELECT count(*) AS vocab_size, count(vecs.token) AS hits,
        round(count(vecs.token) / count(*), 6) AS hit_rate FROM voc LEFT JOIN vecs ON vecs.token = voc.token""",
    "align_hyp_ref": f"{HYP} SELECT sent_id, hyp, ref FROM hyps",
    "oov_report": f"""{PAIRS} SELECT lang, token, freq, round(freq / (SELECT sum(freq) FROM cnt c WHERE c.lang = cnt.lang), 9) AS oov_rate
        FROM cnt WHERE NOT EXISTS (SELECT 1 FROM voc v WHERE v.lang = cnt.lang AND v.token = cnt.token)""",
    "token_counts": f"{DOCS} SELECT * FROM cnt",
    "token_counts_first_seen": f"""{DOCS} SELECT lang, token, count(*) AS freq,
        CAST(min(doc_id * 2147483648 + pos - 1) AS BIGINT) AS first_pos
        FROM (SELECT doc_id, lang, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM toks) GROUP BY 1, 2""",
    "build_vocab": f"{DOCS} SELECT * FROM {vocab('cnt', 5, 25000)}",
    "build_vocab_first_seen": f"""{DOCS}, fcnt AS (SELECT lang, token, count(*) AS freq, min((doc_id, pos)) AS first_pos
        FROM (SELECT doc_id, lang, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM toks) GROUP BY 1, 2)
        SELECT * FROM {vocab('fcnt', 3, None, 'first_pos')}""",
    "vocab_stats": f"""{DOCS}, kept AS (SELECT lang, least(count(*), 24996) AS kept FROM cnt WHERE freq >= 5 GROUP BY 1)
        SELECT lang, count(*) AS unique_types, kept + 4 AS vocab_size, kept, round(kept / count(*), 9) AS type_coverage,
        count(*) - kept AS discarded FROM cnt JOIN kept USING (lang) GROUP BY lang, kept""",
    "vocabulary_totals": f"{DOCS} SELECT lang, CAST(sum(freq) AS BIGINT) AS total_tokens, count(*) AS vocab_size FROM cnt GROUP BY 1",
    "coverage_size": f"""{DOCS} SELECT lang, CAST(t AS DOUBLE) AS threshold, min(rank) AS n_types
        FROM curve, (VALUES (0.9), (0.95), (0.98), (0.99), (0.995)) x(t) WHERE cum::DOUBLE / total >= t::DOUBLE GROUP BY 1, 2""",
    "min_freq_sweep": f"""{DOCS} SELECT lang, CAST(m AS INTEGER) AS min_freq, count(*) FILTER (WHERE freq >= m) AS vocab_size,
        round(coalesce(sum(freq) FILTER (WHERE freq >= m), 0) / sum(freq), 9) AS token_coverage
        FROM cnt, (VALUES (1), (2), (3), (5), (8), (10), (20)) x(m) GROUP BY 1, 2""",
    "top_tokens": f"{DOCS} SELECT lang, rank, token, freq FROM curve WHERE rank <= 20",
    "length_stats": LENGTH_STATS,
    "length_stats_approx": f"""{DOCS} SELECT lang, count(*) AS n, min(len) AS min, max(len) AS max, round(avg(len), 6) AS mean,
        quantile_disc(len, 0.5)::DOUBLE AS median, {PERCENTILES.replace('quantile_cont', 'quantile_disc')} FROM lens GROUP BY 1""",
    "length_histogram": f"""{DOCS}, r AS (SELECT lang, min(len)::DOUBLE AS a, max(len)::DOUBLE AS b FROM lens GROUP BY 1),
        edges AS (SELECT lang, bin, a + bin * ((b - a) / 50) AS lo, CASE WHEN bin = 49 THEN b ELSE a + (bin + 1) * ((b - a) / 50) END AS hi
                  FROM r, range(0, 50) e(bin))
        SELECT e.lang, CAST(bin AS INTEGER) AS bin, round(lo, 6) AS lo, round(hi, 6) AS hi,
            (SELECT count(*) FROM lens l WHERE l.lang = e.lang AND l.len >= lo AND (l.len < hi OR (bin = 49 AND l.len <= hi))) AS n
        FROM edges e""",
    "length_kde": f"""{DOCS}, s AS (SELECT lang, count(*) AS n, min(len) AS a, max(len) AS b, stddev_samp(len) * pow(count(*), -0.2) AS w
            FROM lens GROUP BY 1),
        u AS (SELECT lang, len, count(*) AS c FROM lens GROUP BY 1, 2),
        g AS (SELECT s.*, point, a + point * (b - a)::DOUBLE / 199 AS x FROM s, range(0, 200) p(point))
        SELECT g.lang, CAST(point AS INTEGER) AS point, round(x, 6) AS x,
            round(sum(c * exp(-0.5 * ((x - len) / w) * ((x - len) / w))) / (n * w * sqrt(2 * pi())), 9) AS density
        FROM g JOIN u ON u.lang = g.lang GROUP BY g.lang, point, x, n, w""",
    "suggest_max_len": f"""{PAIRS} SELECT CAST(trunc(greatest(quantile_cont(len(src_tokens), 0.999), quantile_cont(len(tgt_tokens), 0.999))) AS BIGINT)
        AS suggested, greatest(max(len(src_tokens)), max(len(tgt_tokens))) AS global_max FROM ptoks""",
    "corpus_bleu": bleu(HYP, "hyps") + " FROM parts",
    "corpus_bleu_by_split": bleu(
        f"{HYP}, shyps AS (SELECT *, {split_of('sent_id')} AS split FROM hyps)", "shyps", "split"
    ) + " FROM parts",
    "word_evaluation": bleu(
        f"""{PAIRS}, scored AS (SELECT pair_id AS sent_id, {unptb('tgt_known')} AS hyp, tgt AS ref
            FROM pids JOIN pairs USING (pair_id))""",
        "scored",
    ) + " FROM parts",
    "document_bleu": bleu(
        """WITH dhyps AS (SELECT doc_id AS sent_id, lang, text AS ref,
            array_to_string(list_filter(string_split(text, ' '), lambda t, i: (i - 1) % 7 <> 3), ' ') AS hyp FROM documents)""",
        "dhyps",
        "lang",
    ) + " FROM parts",
    "tokens_13a": f"SELECT doc_id, array_to_string({t13a('text')}, ' ') AS tokens FROM documents",
    "pre_token_counts": rf"""{PAIRS}, lines AS (
            SELECT unnest(list_transform(string_split(line, chr(10)), lambda x: x || chr(10))) AS line FROM ({TWO_LINES})),
        pieces AS (SELECT unnest(string_split(regexp_replace(line, '(\s)(\s)(\S)', '\1' || chr(1) || '\2\3', 'g'), chr(1))) AS piece FROM lines)
        SELECT pretoken, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(piece, '{PRE_TOKENS}')) AS pretoken FROM pieces) GROUP BY 1""",
    "epoch_metrics": f"{LOG} SELECT * FROM epochs",
    "coverage_curve": f"{DOCS} SELECT lang, rank, token, freq, cum, round(cum::DOUBLE / total, 9) AS coverage FROM curve",
    "coverage_view": f"{DOCS} SELECT lang, rank, round(cum::DOUBLE / total, 9) AS coverage FROM curve WHERE rank <= 30000",
    "rank_frequency": f"""{DOCS} SELECT lang, rank - 1 AS rank0, freq, CASE WHEN rank > 1 THEN round(log10(rank - 1), 9) END AS log_rank,
        round(log10(freq), 9) AS log_freq FROM curve""",
    "coverage_guides": f"""{DOCS} SELECT lang, CAST(t AS DOUBLE) AS threshold, min(rank) - 1 AS idx0
        FROM curve, (VALUES (0.95), (0.98), (0.99)) x(t) WHERE cum::DOUBLE / total >= t::DOUBLE GROUP BY 1, 2
        HAVING min(rank) - 1 < 30000""",
    "running_best": f"""{LOG}, b AS (SELECT run_id, epoch, mean_loss AS value, coalesce(max(mean_loss) OVER (PARTITION BY run_id ORDER BY epoch
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS before FROM epochs)
        SELECT run_id, epoch, value, greatest(before, value) AS best_so_far, value > before AS is_new_best FROM b""",
    "best_epoch": f"""{LOG} SELECT run_id, epoch, mean_loss AS value FROM epochs
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY mean_loss DESC, epoch) = 1""",
    "make_batches": f"""SELECT doc_id, text, {BATCHED}
        FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)""",
    "make_batches_shuffled": f"""SELECT doc_id, text, {BATCHED}
        FROM (SELECT doc_id, text, row_number() OVER (ORDER BY {h60('7', 'doc_id')}, doc_id) AS rn FROM documents)""",
    "length_bucketed_batches": f"""{DOCS}, o AS (SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n,
            (row_number() OVER (ORDER BY {h60('3', 'doc_id')}, doc_id) - 1) // 128 AS mega FROM toks),
        p AS (SELECT *, row_number() OVER (PARTITION BY mega ORDER BY n DESC, doc_id) - 1 AS place FROM o)
        SELECT doc_id, n, CAST(mega * 8 + place // 16 AS BIGINT) AS batch_id, CAST(place % 16 AS INTEGER) AS pos_in_batch FROM p""",
    "pad_batch": f"""{PAIRS} SELECT pair_id, batch_id, {text_list('src_padded')} AS src_padded, {text_list('tgt_padded')} AS tgt_padded,
        CAST(len(src_ids) AS INTEGER) AS src_len FROM pad""",
    "padding_waste": f"""{PAIRS}, w AS (SELECT batch_id, count(*) * (max(len(src_ids)) + max(len(tgt_ids))) AS cells,
            CAST(sum(len(src_ids) + len(tgt_ids)) AS BIGINT) AS used FROM bat GROUP BY 1)
        SELECT batch_id, cells, cells - used AS pad_cells, round((cells - used) / cells, 9) AS waste FROM w""",
    "total_padding_waste": f"""{PAIRS}, w AS (SELECT sum(len(src_padded) + len(tgt_padded)) AS cells,
            sum(len(src_ids) + len(tgt_ids)) AS used, count(DISTINCT batch_id) AS n_batches FROM pad)
        SELECT n_batches, CAST(cells AS BIGINT) AS cells, CAST(cells - used AS BIGINT) AS pad_cells,
            round((cells - used) / cells, 9) AS waste FROM w""",
    "topk_candidates": """SELECT user_id AS pair_id, event_id AS cand, value AS score, CAST(rn AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 4""",
    "repeated_ngrams": r"""WITH t AS (SELECT doc_id, string_split_regex(text, '\s+') AS w FROM documents),
        g AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')) AS g FROM t)
        SELECT doc_id, len(g) > len(list_distinct(g)) AS repeats FROM g""",
    "sample_predictions": f"{HYP} SELECT sent_id, hyp, ref FROM hyps WHERE {h60('5', 'sent_id')} < {int(0.3 * (1 << 60))}",
    "first_prediction": f"{HYP} SELECT sent_id, hyp, ref FROM hyps ORDER BY sent_id LIMIT 1",
    "stream_encode": f"""{PAIRS} SELECT src, tgt, {IDS} FROM pids JOIN pairs USING (pair_id)
        WHERE len(src_ids) <= 128 AND len(tgt_ids) <= 128""",
    "stream_token_counts": f"{PAIRS} SELECT lang, token, freq FROM cnt",
    "stream_count_changes": f"{PAIRS} SELECT lang, token, freq FROM cnt",
    "map_batches": f"""{PAIRS} SELECT pair_id, '{PREFIX}' || src AS request,
        len(string_split('{PREFIX}' || src, ' ')) AS n_words FROM pairs""",
    "register_metric": bleu(
        rf"""{HYP}, stripped AS (SELECT sent_id, regexp_replace(hyp, '^\s+|\s+$', '', 'g') AS hyp,
            regexp_replace(ref, '^\s+|\s+$', '', 'g') AS ref FROM hyps)""",
        "stripped",
    ) + ", 'bleu' AS metric FROM parts",
    "register_metric_by": bleu(
        f"""{HYP}, stripped AS (SELECT sent_id, regexp_replace(hyp, '^\\s+|\\s+$', '', 'g') AS hyp,
            regexp_replace(ref, '^\\s+|\\s+$', '', 'g') AS ref, {split_of('sent_id')} AS split FROM hyps)""",
        "stripped",
        "split",
    ) + ", 'bleu' AS metric FROM parts",
}
