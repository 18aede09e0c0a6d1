"""The numbered queries with their SQL twins. Each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOP_K = 10


@query(f"""WITH codes AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i:
    CASE WHEN embedding[i + 1] > 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808 ELSE (1::HUGEINT << i) END)::HUGEINT ELSE 0::HUGEINT END))::BIGINT AS code
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
  SELECT query_id, neighbour_id, distance::INT AS distance, rank::INT AS rank FROM (
    SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, bit_count(xor(q.code, b.code)) AS distance,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, b.code)), b.vec_id) AS rank
    FROM codes q, codes b WHERE q.vec_id % 20 = 0) WHERE rank <= {TOP_K}""")
def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every twentieth embedding among all embeddings."""
    from pickwise.llm.hamming_topk import sign_code, top_k

    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(codes, codes.filter(F.col("id") % 20 == 0), TOP_K)


_SECRETS = r"""WITH kinds(kind, rank, pat, grp, least) AS (VALUES
    ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]+', 0, 24),
    ('pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1),
    ('jwt', 4, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 1)),
  docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
  hits AS (SELECT r, kind, rank, least, regexp_extract_all(text, pat) AS found, regexp_extract_all(text, pat, grp) AS part, regexp_split_to_array(text, pat) AS gap
    FROM docs, kinds),
  each AS (SELECT r, kind, rank, least, unnest(range(len(found))) AS i, found, part, gap FROM hits WHERE len(found) > 0),
  spans AS (SELECT r, kind, rank, found[i + 1] AS m, list_sum(list_transform(gap[1:i + 1], lambda x: length(x)))
      + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))), 0) AS s FROM each WHERE length(part[i + 1]) >= least),
  told AS (SELECT r, kind, rank, s::BIGINT AS s, kind || ':' || s::BIGINT || ':' || (s::BIGINT + length(m)) AS t FROM spans),
  sums AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(t, ',' ORDER BY s, rank) AS spans, string_agg(t, ',' ORDER BY s, rank) FILTER (rank < 3) AS base FROM told GROUP BY r)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN sums USING (r)"""


@query(_SECRETS)
def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document through a fresh ledger: a document is a path with one version."""
    from pickwise.llm.secret_ledger import BASE, joined, scan

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    found = scan(docs, scratch_path(spark, "ledger"))
    kinds = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"), *[count(k) for k in kinds], F.sha2(joined(F.col("findings"), tuple(kinds)), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


@query("""WITH t AS (SELECT conv_id // 2 AS pair_id, CASE conv_id % 2 WHEN 0 THEN 'chosen' ELSE 'rejected' END AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS pos, '<|' || role || '|>' || chr(10) || text || chr(10) AS line FROM t),
  place AS (SELECT pair_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM placed GROUP BY pair_id, pos),
  prefix AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos))::INT AS prefix_turns FROM place GROUP BY pair_id),
  told AS (SELECT placed.*, prefix_turns, sum(CASE WHEN pos > prefix_turns THEN length(line) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY pos) AS stop
    FROM placed JOIN prefix USING (pair_id)),
  sides AS (SELECT pair_id, side, coalesce(string_agg(line, '' ORDER BY pos) FILTER (pos > prefix_turns), '') AS completion,
      coalesce(string_agg((stop - length(text) - 1)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY pos) FILTER (pos > prefix_turns AND role = 'assistant'), '') AS mask,
      coalesce(string_agg(line, '' ORDER BY pos) FILTER (pos <= prefix_turns), '') AS prompt FROM told GROUP BY pair_id, side)
  SELECT pair_id, prefix_turns, coalesce(max(prompt) FILTER (side = 'chosen'), '') AS prompt, max(completion) FILTER (side = 'chosen') AS chosen,
    max(mask) FILTER (side = 'chosen') AS chosen_mask, max(completion) FILTER (side = 'rejected') AS rejected, max(mask) FILTER (side = 'rejected') AS rejected_mask
  FROM sides JOIN prefix USING (pair_id) GROUP BY pair_id, prefix_turns""")
def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, as the chosen (even id) or rejected (odd id) side of the pair id // 2; masks as start:end lists."""
    from pickwise.llm.preference_format import format_pairs

    conv = F.col("conv_id")
    turns = table(spark, sf_dir, "conversations").select(
        F.floor(conv / 2).alias("pair_id"), F.when(conv % 2 == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text"
    )
    mask = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")).alias(c)
    return format_pairs(turns).select("pair_id", "prefix_turns", "prompt", "chosen", mask("chosen_mask"), "rejected", mask("rejected_mask"))


@query()
def op7_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with weights fitted on the pages that mark their content."""
    from pickwise.llm.best_region import extract

    return extract(table(spark, sf_dir, "pages"))


@query()
def op9_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    from pickwise.llm.grouping_pack import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_WORD_SETS = r"""docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
  sets AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM docs),
  tokens AS (SELECT r, unnest(s) AS t FROM sets),
  common AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM tokens a JOIN tokens b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
  links AS (SELECT x, y FROM common JOIN sets a ON a.r = x JOIN sets b ON b.r = y WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n))"""


@query(f"""WITH RECURSIVE {_WORD_SETS},
  both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach AS (SELECT r, r AS other FROM sets UNION SELECT reach.r, y FROM reach JOIN both_ways ON other = x)
  SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM reach JOIN sets s ON s.r = reach.r JOIN sets o ON o.r = other
  GROUP BY s.r, s.doc_id, s.s""")
def op10_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose five-word shingle sets are at least 0.75 alike."""
    from pickwise.llm.set_relation_join import components

    return components(table(spark, sf_dir, "documents"))


@query()
def op2_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model fitted on labelled documents outside the held-out fold."""
    from pickwise.llm.common import held_out
    from pickwise.llm.crf_langid import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "words", "switches")


QUALITY_CUT = 0.3


@query()
def op8_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a model fitted on labels outside the held-out fold."""
    from pickwise.llm.attention_mil import Fit, fit, predict
    from pickwise.llm.common import bounded_sample, held_out

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    # as many label rows as the fit may use, so the broadcast is bounded
    some = bounded_sample(labels.filter(F.col("label").isin(0, 1)), ["doc_id", "label"], F.lit(0), Fit.rows, 0)
    found = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"), "passages", "top_attention")


@query()
def op6_wand_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair of a leaked item, with the words it shares."""
    from pickwise.llm.wand_decontaminate import contaminated, split_item

    question, answer = split_item(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", question.alias("question"), answer.alias("answer"))
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), items)


_REPEATS = r"""WITH docs AS (SELECT doc_id, text, list_filter(regexp_split_to_array(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL GROUP BY doc_id, text),
  keyed AS (SELECT row_number() OVER () AS r, doc_id, w FROM docs),
  wins AS (SELECT r, unnest(list_transform(range(1, len(w) - 48), lambda i: {'at': i - 1, 'g': md5(array_to_string(w[i:i + 49], ' '))})) AS x FROM keyed WHERE len(w) >= 50),
  shared AS (SELECT x.g AS g FROM wins GROUP BY x.g HAVING min(r) <> max(r)),
  hit AS (SELECT DISTINCT r, x.at AS s FROM wins JOIN shared ON x.g = shared.g),
  marked AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
  runs AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS run FROM marked)
  SELECT doc_id, min(s)::BIGINT AS start, (max(s) + 50)::BIGINT AS "end" FROM runs JOIN keyed USING (r) GROUP BY r, run, doc_id"""


@query(_REPEATS)
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of at least 50 words that stand in more than one document, for all documents."""
    from pickwise.llm.suffix_dedup import repeats

    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the library's count, pre-tokens that are whole tokens counted directly."""
    import public_tokenizers

    from pickwise.llm.token_counts import counts

    return counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 32 whitening components of all embeddings."""
    from pickwise.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


_PHRASES = r"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  split AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
  pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM split),
  totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
  occ AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k),
  freq AS (SELECT lang, k, phrase, count(*) AS f FROM occ GROUP BY ALL HAVING count(*) >= 30),
  cand AS (SELECT *, string_split(phrase, ' ') AS w FROM freq WHERE k > 1),
  held AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM cand, (VALUES (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)) AS t(m, i)
    WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
  kept AS (SELECT cand.* FROM cand LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * f),
  cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.j], ' ')
    JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.j + 1:c.k], ' ')),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM best JOIN totals USING (lang) QUALIFY rank <= 2000"""


@query(_PHRASES)
def op11_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language over all documents."""
    from pickwise.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))
