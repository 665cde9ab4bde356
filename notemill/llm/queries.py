"""The thin queries over the tables of a folder, one for each operator of this subpackage.

Each applies its operator, with production parameters, to the whole table, and derives the
columns that its contract names from the operator's own outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, tokenizer_path(), decoded_col="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chat, read_turns

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    windows = format_chat(turns.unionByName(own), budget=2048, history=512)
    same = F.col("learnt") == F.col("text")
    part = F.when(~F.col("repeated"), F.struct("ordinal", "role", "text", F.when(~same, F.col("learnt")).alias("learnt")))
    back = read_turns(windows).groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.count("chars").alias("n_windows"), F.sort_array(F.collect_list(part)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("p", lambda x: F.coalesce(x["learnt"], x["text"])), "")
    digests = back.select("conv_id", F.size("p").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), learnt.alias("learnt"), "formatted_chars", "n_windows")
    return digests.select("conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, secret_scan, spans_string

    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base_secrets", lambda x: x["kind"])
    number = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *number, F.sha2(spans_string(F.col("base_secrets")), 256).alias("base_sha256"), spans_string(F.col("secrets")).alias("spans"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    found = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import classes

    found = classes(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits: five code points of its first third
    give way to a note with its id, one is put in at two thirds, and a sentence at the end."""
    from .counts import build, edit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit(""))).cast("int")
    change = lambda at, cut, put: F.struct(at.cast("int").alias("at"), F.lit(cut).alias("cut"), put.alias("put"))
    note = F.concat(F.lit(" [note "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("]"))
    edits = F.array(change(F.floor(n / 3), 5, note), change(F.floor(n * 2 / 3), 0, F.lit("é, x")), change(n + 100, 0, F.lit(" The end.")))
    state = build(docs, tokenizer_path()).withColumns({"tokens_before": F.col("n_tokens"), "edits": edits})
    done = edit(state, tokenizer_path(), "edits")
    return done.select("doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), F.length("text").cast("long").alias("n_chars_after"), F.size("piece_chars").cast("long").alias("n_pieces"), "reencoded_chars")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of distances are over at most ``k`` clusters."""
    import hashlib

    from .kmeans import centroid_clusters

    found, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, seed=2)
    sums = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    rows = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of letters of a document whose checksum with the document's id is a multiple of 199 loses a letter before it is counted."""
    from .variants import variants, word_counts

    def change(doc_id, run):
        h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
        cut = (h % F.length(run)).cast("int")
        return F.when(h % 199 == 0, F.concat(F.left(run, cut), F.substr(run, cut + 2))).otherwise(run)

    return variants(word_counts(table(spark, sf_dir, "documents"), change=change, least_letters=6, least_n=5), ratio=5)


def op13_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subspace import embedding_near

    return embedding_near(table(spark, sf_dir, "embeddings"), least=0.93)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substring": op2_substring,
    "op3_chat": op3_chat,
    "op4_secrets": op4_secrets,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_counts": op9_counts,
    "op10_bpe": op10_bpe,
    "op11_clusters": op11_clusters,
    "op12_variants": op12_variants,
    "op13_embedding_near": op13_embedding_near,
}

def _op1_sql() -> str:
    """The base columns and the line rules; the same patterns, counted with SQL alone."""
    from . import quality as Q

    text = lambda p: "'" + p.replace("'", "''") + "'"
    drop = lambda c, p: f"regexp_replace({c}, {text(p)}, '', 'g')"
    gone = lambda c, p: f"(length({c}) - length({drop(c, p)}))"
    space, symbols = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
    n, bars, signs = f"len(regexp_extract_all(line, {text(Q.WORD_PATTERN)}))", gone("line", "[|»›•]"), gone("line", symbols)
    shouts = "((length(line) - length(replace(line, '!!', ''))) / 2)"
    failed = f"""regexp_matches(line, {text("[^" + space[1:])}) AND ({bars} >= 3 AND {bars} * 6 >= {n} OR regexp_matches(lower(line), {text(Q.MENU_PATTERN)})
        OR {signs} * 2 > {n} AND {signs} >= 3 OR {shouts} * 5 > {n} AND {shouts} >= 3
        OR {n} <= 30 AND regexp_matches(lower(line), {text(Q.BOILERPLATE_PATTERN)}) OR NOT regexp_matches(line, {text(Q.SENTENCE_PATTERN)}))"""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
      w AS (SELECT r, list_filter(string_split_regex(t, {text(space + "+")}), lambda x: x <> '') AS w FROM d),
      g AS (SELECT r, unnest(generate_series(1, len(w) - 4)) AS i, w FROM w WHERE len(w) >= 5),
      c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM g) WHERE n > 1),
      cover AS (SELECT r, sum(least(5, coalesce(next - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM c) GROUP BY r),
      l AS (SELECT r, line, length({drop("line", space)}) AS chars FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
      s AS (SELECT r, count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS dup, coalesce(sum(chars) FILTER ({failed}), 0) AS lost FROM l GROUP BY r),
      b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length({drop("t", space)}) AS BIGINT) AS word_chars, CAST({gone("t", symbols)} AS BIGINT) AS n_symbols,
        CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, lost FROM d JOIN w USING (r) JOIN s USING (r) LEFT JOIN cover USING (r)),
      f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
    SELECT * EXCLUDE (lost), NOT base_failed AND lost * 100 <= word_chars * 30 AS kept FROM f"""


_OP8_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

def _op3_sql() -> str:
    """Windows turn by turn: spans from running sums, and for each span its history and system turn."""
    from . import chat as C

    said = "</s>[INST] ok [/INST]"
    text = lambda p: "'" + p.replace("'", "''") + "'"
    marks = "|".join(x[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for x in C.CONTROL)
    escape = lambda c: f"regexp_replace(replace({c}, '\\', '\\\\'), {text(r'([<' + chr(92) + '[])(' + marks + ')')}, {text(chr(92) + '1' + chr(92) * 2 + chr(92) + '2')}, 'g')"
    return f"""
    WITH t AS (SELECT conv_id AS c, turn AS t, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations UNION ALL SELECT -7, 0, 'user', {text(said)} UNION ALL SELECT -7, 1, 'assistant', {text(said)}),
      s AS (SELECT *, length({text(C.START)}) + length(replace({escape("role")}, chr(10), chr(92) || chr(10))) + 1 + length({escape("x")}) + {len(C.END)} AS size FROM t),
      n AS (SELECT *, CAST(ceil(size / 4) AS BIGINT) AS n FROM s),
      a AS (SELECT *, row_number() OVER w - 1 AS k, sum(n) OVER w AS after FROM n WINDOW w AS (PARTITION BY c ORDER BY t NULLS FIRST, role, x ROWS UNBOUNDED PRECEDING)),
      y AS (SELECT c AS yc, min(k) AS sk, arg_min(n, k) AS sn, arg_min(size, k) AS ssize FROM a WHERE role = 'system' GROUP BY c),
      r AS (SELECT a.*, sk, ssize, after - n AS before, greatest(2048 - 512 - coalesce(sn, 0), 1) AS room FROM a LEFT JOIN y ON c IS NOT DISTINCT FROM yc),
      p AS (SELECT *, 2 * floor(before / room) + CASE WHEN floor(before / room) = floor((after - 1) / room) THEN 0 ELSE 1 END AS span FROM r),
      b AS (SELECT c AS bc, span AS bspan, min(before) AS s0, min(k) AS k0, any_value(sk) AS bsk, any_value(ssize) AS bsize FROM p GROUP BY ALL),
      m AS (SELECT c, span, size FROM p UNION ALL SELECT bc, bspan, bsize FROM b WHERE k0 > bsk
        UNION ALL SELECT c, bspan, size FROM p JOIN b ON c IS NOT DISTINCT FROM bc AND after <= s0 AND before >= s0 - 512 AND n <= 512 AND k IS DISTINCT FROM sk),
      f AS (SELECT c AS fc, CAST(sum(size) AS BIGINT) AS formatted_chars, count(DISTINCT span) AS n_windows FROM m GROUP BY c),
      d AS (SELECT c, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(string_agg(x, '' ORDER BY k) FILTER (role = 'assistant'), '') AS learnt FROM a GROUP BY c)
    SELECT c AS conv_id, n_turns, turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars, n_windows FROM d JOIN f ON c IS NOT DISTINCT FROM fc"""


#: Words and repeated windows of 35 words, each known by its own text; windows are judged on the input.
_OP2_SQL = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      g AS (SELECT r, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
      c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
      p AS (SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(generate_series(i, i + 34)) AS j FROM c) GROUP BY r),
      k AS (SELECT doc_id, len(w) AS n, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN p USING (r))
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid in each round; centroids as lists of whole numbers."""
    distance = "list_sum(list_transform(list_zip(q, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS c, q AS z FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k}))"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, vec_id, q, c, {distance} AS d FROM v, c{i}) GROUP BY r, vec_id, q)")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(y, z) AS z FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS y
        FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(len(q))) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) USING (c))""")
    return "WITH " + ",\n      ".join(steps) + f"""
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(z, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


#: The checksum is worked out byte by byte with its 256-entry table, made from the polynomial. Near words by the strings that they share when a letter of
#: the one, the other or each is left out.
_OP12_SQL = """
    WITH t AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x FROM range(256) r(i))),
      r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
      d AS (SELECT w, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM r GROUP BY ALL),
      b AS (SELECT w, n, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b FROM d),
      h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS h FROM b, t),
      c AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n) AS n FROM h GROUP BY 1),
      w AS (SELECT word, CAST(n AS BIGINT) AS n FROM c WHERE length(word) >= 6 AND n >= 5),
      o AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
      p AS (SELECT a.word, b.word AS near, b.n AS m FROM o a JOIN o b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT o.word, w.word, w.n FROM o JOIN w ON o.rest = w.word UNION SELECT w.word, o.word, o.n FROM o JOIN w ON o.rest = w.word),
      f AS (SELECT word, n, count(near) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM w LEFT JOIN p USING (word) GROUP BY word, n),
      g AS (SELECT word, n, n_near, CASE WHEN m >= 5 * n THEN near END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM f),
      x(word, root) AS (SELECT word, word FROM g UNION ALL SELECT x.word, g.form FROM x JOIN g ON x.root = g.word WHERE g.form IS NOT NULL)
    SELECT g.word, g.form, x.root, g.n, g.n_near, g.form_n FROM g JOIN x USING (word) JOIN g e ON e.word = x.root WHERE e.form IS NULL"""

_OP13_SQL = """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
      f AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
      l AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM f a JOIN f b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
      x(r, o, id) AS (SELECT a, b, id FROM l UNION SELECT x.r, l.b, l.id FROM x JOIN l ON x.o = l.a),
      m AS (SELECT r, min(id) AS id FROM x GROUP BY r), n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a),
      c AS (SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, m.id) AS component_id FROM v LEFT JOIN m USING (r) LEFT JOIN n USING (r))
    SELECT *, vec_id IS NOT DISTINCT FROM component_id AS kept FROM c"""

#: DuckDB SQL of the same rows, where SQL can express them.
ORACLE_SQL: dict[str, str] = {"op1_quality": _op1_sql(), "op2_substring": _OP2_SQL, "op3_chat": _op3_sql(), "op8_topk": _OP8_SQL, "op11_clusters": _op11_sql(), "op12_variants": "WITH RECURSIVE" + _OP12_SQL.lstrip()[4:], "op13_embedding_near": "WITH RECURSIVE" + _OP13_SQL.lstrip()[4:]}
