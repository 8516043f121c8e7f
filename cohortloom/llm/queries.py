"""Registered queries of the pipeline operators, over whole tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm import (
    chat,
    decontaminate,
    language,
    line_dedup,
    multi_index,
    near_dedup,
    packing,
    repeats,
    resampling,
    secrets,
    toxicity,
    vector_codes,
    warc,
)
from cohortloom.llm.sampling import bounded_sample, fingerprints, remainder
from cohortloom.plans.registry import Registry

registry = Registry()
query = registry.query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_model(docs: DataFrame, train_on=None, per_label: int = 500) -> language.LanguageModel:
    """Fitted on about `per_label` rows of every language, of at most 20,000 characters."""
    rows = docs if train_on is None else docs.filter(train_on)
    known = rows.filter(F.col("lang").isNotNull())
    marked = fingerprints(known.withColumn("label", F.col("lang")), "doc_id", "text", "label")
    return language.train(bounded_sample(marked, known, "doc_id", "text", per_label, 20_000))


@query()
def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = language_model(docs, ~held_out)
    found = language.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def toxicity_model(docs: DataFrame, labels: DataFrame, train_on) -> toxicity.ToxicityModel:
    """Fitted on about 4,000 toxic, clean and unlabelled texts each, of at most 20,000 characters.

    The class prior is the share of toxic rows among the labelled ones of the
    training part. Clean ones only serve, with a quarter of the toxic ones, to
    map the logit to a probability.
    """
    train_ids = labels.filter(train_on).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = docs.filter(train_on)
    counted = train_ids.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = min(max(counted or 0.0, 1e-3), 0.5)
    group = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").otherwise("open")
    marked = fingerprints(seen, "doc_id", "text").join(
        train_ids.withColumnRenamed("doc_id", "key"), "key", "left"
    )
    marked = marked.withColumn("label", group)
    sample = bounded_sample(marked, seen, "doc_id", "text", 4000, 20_000)
    names = np.array(sample.column("label").to_pylist(), dtype=object)
    texts = sample.column("text").combine_chunks()
    held = np.arange(len(names)) % 4 == 0
    toxic, clean, open_ = names == "toxic", names == "clean", names == "open"
    if not open_.any():
        open_ = clean & ~held
    checked = held & (toxic | clean)

    def pick(mask):
        return texts.filter(pa.array(mask, pa.bool_()))

    return toxicity.train(
        pick(toxic & ~held), pick(open_), prior, (pick(checked), toxic[checked].astype(float))
    )


@query()
def op8_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = toxicity_model(docs, labels, ~held_out)
    found = toxicity.toxicity(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


_OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS id, doc_id AS r FROM sets
  UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, c.component_id, c.component_id = sets.doc_id AS kept
FROM sets JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = sets.doc_id
"""


@query(_OP3_SQL)
def op3_near_duplicates(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, how=near_dedup.Settings(words=3, percent=85, rows=8))


@query()
def op7_best_fit_packing(spark, sf_dir):
    import public_tokenizers  # only this operator needs it

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query()
def op5_decontaminate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.inline("leaks"))


_OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
plain AS (SELECT *, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS line FROM lines),
classes AS (
  SELECT line, min(row(doc_id, i)) AS o, string_split(line, ' ') AS w FROM plain WHERE line <> '' GROUP BY line),
variants AS (
  SELECT line, o, q, len(w) AS n, array_to_string(list_concat(w[:q - 1], w[q + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS q FROM classes WHERE len(w) >= 8)),
firsts AS (SELECT v, q, min(o) AS o FROM variants GROUP BY v, q),
near AS (
  SELECT a.line FROM variants a JOIN firsts f ON a.v = f.v AND a.q = f.q AND f.o < a.o
  UNION SELECT a.line FROM variants a JOIN classes b ON a.v = b.line AND b.o < a.o
  UNION SELECT b.line FROM variants a JOIN classes b ON a.v = b.line AND a.o < b.o),
marked AS (
  SELECT p.doc_id, p.i, p.raw, coalesce(c.o <> row(p.doc_id, p.i) OR c.line IN (SELECT line FROM near), FALSE) AS gone
  FROM plain p LEFT JOIN classes c ON p.line = c.line),
rest AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
    coalesce(string_agg(i, ',' ORDER BY i) FILTER (gone), '') AS removed_lines FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(r.text), 0)::BIGINT AS n_chars, sha256(coalesce(r.text, '')) AS text_sha256,
  coalesce(r.removed_lines, '') AS removed_lines FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id
"""


@query(_OP4_SQL)
def op4_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs)
    return found.select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
    )


_OP9_SQL = r"""
WITH pieces AS (
  SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS k
  FROM (SELECT doc_id, string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)) AS parts
        FROM documents WHERE text IS NOT NULL)),
worded AS (
  SELECT *, list_filter(string_split_regex(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM pieces WHERE piece <> ''),
numbered AS (
  SELECT *, sum(CASE WHEN len(words) > 0 OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS u
  FROM worded),
units AS (
  SELECT doc_id, u, string_agg(piece, '' ORDER BY k) AS piece, flatten(list(words ORDER BY k)) AS words
  FROM numbered GROUP BY doc_id, u),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY u) AS finish,
    len(words) > 0 AND row_number() OVER (PARTITION BY words ORDER BY doc_id, u) > 1 AS again FROM units),
runs AS (
  SELECT *, u - row_number() OVER (PARTITION BY doc_id, again ORDER BY u) AS run FROM placed),
sized AS (
  SELECT *, again AND sum(len(words)) OVER (PARTITION BY doc_id, again, run) >= 25 AS gone FROM runs),
spans AS (
  SELECT doc_id, min(finish - length(piece)) AS first, max(finish) AS last FROM sized WHERE gone
  GROUP BY doc_id, run),
listed AS (
  SELECT doc_id, count(*) AS n, string_agg(first || ':' || last, ',' ORDER BY first) AS removed FROM spans
  GROUP BY doc_id),
rest AS (
  SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY u) FILTER (NOT gone), '') AS text FROM sized GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.n, 0)::BIGINT AS n_removed, coalesce(l.removed, '') AS removed_spans,
  coalesce(length(r.text), 0)::BIGINT AS n_chars, sha256(coalesce(r.text, '')) AS text_sha256
FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id
"""


@query(_OP9_SQL)
def op9_repeated_passages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.drop_repeats(docs)
    spans = F.transform("removed_spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id",
        F.size("removed_spans").cast("long").alias("n_removed"),
        F.array_join(spans, ",").alias("removed_spans"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


# The same patterns as in `secrets`, in a dialect without look-around: whole runs, then their tests.
_OP10_SQL = r"""
WITH patterns(kind, rank, pattern, least) AS (VALUES
  ('assign', 1, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 1),
  ('access', 2, 'AKIA[A-Z0-9]+', 20), ('hex', 3, '[0-9a-f]+', 24), ('token', 4, '[A-Za-z0-9+/_=-]+', 32),
  ('identifier', 5, '(?i:user_?name|user|login|client_?id|account)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@+-]{3,}', 1),
  ('endpoint', 6, 'https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s"''<>]*)?', 1)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT r, kind, rank, least, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS pieces
  FROM docs, patterns WHERE regexp_matches(text, pattern)),
found AS (
  SELECT r, kind, rank, least, unnest(m) AS v, unnest(list_transform(pieces[:len(m)], lambda p: length(p))) AS gap,
    generate_subscripts(m, 1) AS i FROM cut),
placed AS (
  SELECT *, sum(gap + length(v)) OVER (PARTITION BY r, kind ORDER BY i) AS finish FROM found),
parts AS (
  SELECT r, kind, rank, finish - length(v) AS start, finish FROM placed
  WHERE length(v) >= least
    AND (kind <> 'assign' OR length(regexp_extract(v, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 6)
    AND (kind <> 'token' OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))),
base AS (SELECT * FROM parts WHERE rank <= 3),
weak AS (
  SELECT * FROM parts w WHERE rank > 3
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.start < w.finish AND w.start < b.finish)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
linked AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM weak w WHERE EXISTS (
    SELECT 1 FROM every p WHERE p.r = w.r AND p.start <= w.finish + 200 AND w.start <= p.finish + 200
      AND CASE w.kind WHEN 'token' THEN p.kind IN ('access', 'identifier', 'endpoint')
                      ELSE p.kind IN ('assign', 'hex', 'token') END)),
listed AS (
  SELECT r, string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, rank) AS spans,
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, rank) FILTER (rank <= 3) AS based,
    count(*) FILTER (rank = 1) AS a, count(*) FILTER (rank = 2) AS b, count(*) FILTER (rank = 3) AS c
  FROM linked GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
"""


@query(_OP10_SQL)
def op10_secret_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)

    def joined(spans):
        lines = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(lines, ",")

    def only(*kinds):
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(only(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(joined(only(*secrets.BASE)), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


@query()
def op2_nearest_vectors(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.nearest(vectors, F.col("vec_id") % 20 == 0)


_ODD_TEXT = "</s>[INST] ok [/INST]"
_DELTA_CHARS = 400


def conversation_log(turns: DataFrame) -> DataFrame:
    """The log that would lead to the given turns: every text is streamed in pieces.

    Rows of one conversation get their numbers by turn (then role and text), so
    repeated turns stay apart. An assistant turn has a first draft that is
    regenerated before its pieces come.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role", text.alias("text"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)).cast("int"), F.lit(_DELTA_CHARS)),
        lambda i: F.struct(
            F.lit("delta").alias("kind"), F.substring(F.col("text"), i + 1, F.lit(_DELTA_CHARS)).alias("text")
        ),
    )

    def event(kind, said):
        return F.array(F.struct(F.lit(kind).alias("kind"), F.lit(said).alias("text")))

    start = F.when(
        F.col("role") == "assistant",
        F.concat(event("message", "a first draft"), event("regenerate", "")),
    ).otherwise(event("message", ""))
    rows = rows.select("conv_id", "turn", "role", F.posexplode(F.concat(start, pieces)).alias("i", "e"))
    return rows.select(
        "conv_id",
        "turn",
        (F.col("turn") * 1_000_000 + F.col("i")).alias("seq"),
        "e.kind",
        "role",
        "e.text",
    )


def _said(alias):
    return f"coalesce({alias}.role, '') AS role, coalesce({alias}.text, '') AS text"


_OP6_SQL = f"""
WITH turns AS (
  SELECT c.conv_id, c.turn, {_said('c')} FROM conversations c
  UNION ALL SELECT -1, 0, 'user', '{_ODD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{_ODD_TEXT}'),
sized AS (
  SELECT *, length(regexp_replace(text, '([\\\\<>\\[])', '\\\\\\1', 'g')) AS shown,
         length(regexp_replace(role, '([\\\\<>\\[])', '\\\\\\1', 'g')) AS marked FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 2 * marked + 9 END)::BIGINT
    AS formatted_chars
FROM sized GROUP BY conv_id
"""


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted string and loss spans alone."""
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long,"
        " loss_sha256 string, formatted_chars long"
    )

    def digest(batches):
        for batch in batches:
            rows = []
            for conv, whole, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = list(chat.parse(whole))
                every = hashlib.sha256()
                for role, text, _ in turns:
                    every.update(f"{role}\n{text}\n".encode())
                masked = [chat.unescape(whole[s["start"] : s["end"]]) for s in loss]
                learned = "".join(masked)
                rows.append(
                    (
                        conv,
                        len(turns),
                        every.hexdigest(),
                        len(learned),
                        hashlib.sha256(learned.encode()).hexdigest(),
                        len(whole),
                    )
                )
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(digest, schema)


@query(_OP6_SQL)
def op6_chat_format(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql(
        f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{_ODD_TEXT}' AS text"
        f" UNION ALL SELECT -1L, 1L, 'assistant', '{_ODD_TEXT}'"
    )
    return read_back(chat.format_log(conversation_log(turns.unionByName(odd))))


def _lloyd_sql(rounds: int) -> str:
    """The CTEs a<i> (row, part, 256 * distance + entry) and c<i + 1> of every round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, x.p, min((xx - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x))::BIGINT * 256 + j) AS m
  FROM parts x JOIN c{i} c ON x.p = c.p GROUP BY r, x.p)""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT p, j, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT p, j, list(v ORDER BY k) AS x FROM (
      SELECT p, m % 256 AS j, k, floor(sum(v) / count(*)) AS v FROM (
        SELECT p, m, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM parts JOIN a{i} USING (r, p))
      GROUP BY ALL) GROUP BY p, j) n USING (p, j))""")
    return ",\n".join(steps[:-1])


_OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cut AS (SELECT *, len(v) // 4 AS w FROM kept),
parts AS MATERIALIZED (
  SELECT r, p, x, list_inner_product(x, x) AS xx FROM (
    SELECT r, p, v[p * w + 1 : p * w + w] AS x FROM cut, range(4) t(p))),
c0 AS (SELECT p, r AS j, x FROM parts WHERE r < 256),
{_lloyd_sql(4)},
coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error
  FROM a4 GROUP BY r),
books AS (
  SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, j, k)) AS codebooks_sha256
  FROM (SELECT p, j, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM c4))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books
"""


@query(_OP13_SQL)
def op13_vector_codes(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    codes, books = vector_codes.compress(vectors, keep=["label"])
    found = vector_codes.label_errors(codes, "label").drop("label")
    return found.withColumn("codebooks_sha256", F.lit(books.sha256()))


_OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
owners AS (SELECT h, max(page_id) AS o FROM p GROUP BY h),
fives AS (
  SELECT h, o, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31), 1)), '') AS b FROM owners)
SELECT page_id, n::BIGINT AS payload_bytes, b AS payload_digest,
  CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> o THEN o END AS refers_to
FROM p JOIN fives USING (h)
"""


@query(_OP12_SQL)
def op12_warc(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = warc.read_archives(warc.write_archives(pages))
    return found.filter(F.col("record_type") != "warcinfo").select(
        warc.key_of(F.col("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.key_of(F.col("refers_to")).cast("long").alias("refers_to"),
    )


# A feature's bytes as bits of a shift register: each byte enters, then eight steps.
_OP11_SQL = r"""
WITH words AS (
  SELECT k, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS k, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
runs AS (
  SELECT k, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM words),
counted AS MATERIALIZED (SELECT k, r, f, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(4 * len(h)),
      lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(h, (i // 4 + 1)::BIGINT, 2))::BIGINT ELSE 0::BIGINT END)),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END),
    4294967295) % 10000 AS bucket FROM hexed),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (k = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (k = 1), 0)::DOUBLE AS t
  FROM counted JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM sums, totals),
weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE k = 0 GROUP BY r),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE k = 0),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""


@query(_OP11_SQL)
def op11_importance_resampling(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, read(spark, sf_dir, "benchmark").select("text"))
