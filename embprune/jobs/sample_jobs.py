"""Sources, sinks and samples: vector chunks, member tables, shards, id lists, zero-shot scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators import samples, subsets, zeroshot
from ..sources import embeddings, files, npy, shards
from ..sources.tables import new_path, read_table, stage_table
from . import roles
from .roles import ALLOWED, TEMPLATES
from .roles import SQL_ROLES as R

BASE_SIZE, PER_SHARD, WORKERS, FIRST = 100_000, 100, 3, 50
#: Rows of a chunk, conversations of a shard and documents of a file: their numbers grow with the tables.
CHUNK_ROWS, TALKS, PAGE = 64, 20, 100


def load_embeddings(spark, d):
    return roles.vectors(spark, d).select("id", "label", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("length"))


def _ranked(spark, d):
    place = F.col("rank") - 1
    ranked = subsets.global_rank(roles.vectors(spark, d).select("id", "embedding"), "id")
    return ranked.select(F.floor(place / CHUNK_ROWS).alias("chunk"), (place % CHUNK_ROWS).alias("pos"), "id", "embedding")


def _chunks(spark, d):
    folder = new_path(spark, "npy")
    npy.write_npy(_ranked(spark, d), folder, "chunk", "pos")
    return npy.read_npy(spark, f"{folder}/*.npy")


def _metadata(spark, d):
    """Numbered metadata files in the shared folder, and their numbers."""
    folder, rows = new_path(spark, "metadata"), _ranked(spark, d).select("chunk", "pos", "id")
    written = files.write_files(embeddings.metadata_files(rows, "chunk", "pos"), folder)
    return folder, range(written.count())


def read_npy_chunks(spark, d):
    return _chunks(spark, d).select("chunk", "pos", F.round(norm(F.col("embedding")), 6).alias("length"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def zip_chunk_metadata(spark, d):
    folder, numbers = _metadata(spark, d)
    ids = embeddings.read_metadata(spark, folder, "metadata", list(numbers))
    return embeddings.zip_metadata(_chunks(spark, d), ids).select("chunk", "pos", "id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def positional_ids(spark, d):
    return _chunks(spark, d).select(embeddings.positional_id(F.col("chunk"), F.col("pos"), BASE_SIZE).alias("id"), "chunk", "pos")


def read_metadata_chunk(spark, d):
    folder, numbers = _metadata(spark, d)
    rows = embeddings.read_metadata(spark, folder, "metadata", list(numbers)).withColumn("file", F.regexp_extract(F.input_file_name(), "[^/]*$", 0))
    return rows.groupBy("file", "chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("pos").alias("last_pos"))


def image_folder_index(spark, d):
    docs = read_table(spark, d, "documents").select(F.concat_ws("/", "source", F.concat(F.floor(F.col("doc_id") / PAGE).cast("string"), F.lit(".txt"))).alias("path"), "doc_id")
    pages = docs.groupBy("path").agg(F.encode(F.count("*").cast("string"), "utf-8").alias("content"))
    folder = new_path(spark, "folders")
    files.write_files(pages, folder).count()
    found = embeddings.folder_index(files.list_files(spark, f"{folder}/*/*"))
    return found.select(F.regexp_extract("path", "[^/]*/[^/]*$", 0).alias("path"), "label")


def _members(spark, d):
    turns = read_table(spark, d, "conversations")
    shard = F.floor(F.col("conv_id") / TALKS).cast("string")
    return turns.select(shard.alias("shard"), F.format_string("%09d", "conv_id").alias("key"), F.col("turn").cast("string").alias("ext"), F.encode("text", "utf-8").alias("content"), F.col("turn").alias("pos"))


def _written_shards(spark, members):
    folder = new_path(spark, "shards")
    listed = stage_table(shards.write_tar_shards(members, folder), "listed")
    return folder, listed


def _shard_name(df):
    return df.withColumn("shard", F.regexp_extract("shard", "([^/]*)[.]tar$", 1))


def read_tar_shards(spark, d):
    folder, _ = _written_shards(spark, _members(spark, d).dropDuplicates(["shard", "key", "ext"]))
    found = samples.decoded_only(shards.read_tar_shards(spark, f"{folder}/*.tar"))
    return _shard_name(found).select("shard", "key", "ext", F.length("content").alias("n_bytes"))


def read_tolerant(spark, d):
    """Members of shards decoded as numbers: those that are none are passed over, and so is what follows where a shard breaks off."""
    pages = read_table(spark, d, "pages").select(F.floor(F.col("page_id") / PAGE).cast("string").alias("shard"), F.format_string("%09d", "page_id").alias("key"), F.lit("cls").alias("ext"), F.encode(F.regexp_extract("url", "([0-9]*)/?$", 1), "utf-8").alias("content"))
    folder, _ = _written_shards(spark, pages)
    broken = spark.createDataFrame([("broken.tar", bytearray(b"no tar at all" * 99))], "path string, content binary")
    files.write_files(broken, folder).count()
    found = samples.decoded_only(samples.decode(shards.read_tar_shards(spark, f"{folder}/*.tar"), "content", int, "bigint"))
    return found.select(F.col("key").cast("bigint").alias("page_id"), F.col("value").alias("number"))


def _ranked_docs(spark, d):
    return subsets.global_rank(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def write_tar_shards(spark, d):
    packed = samples.fixed_shards(_ranked_docs(spark, d), PER_SHARD)
    members = packed.select(F.col("out_shard").cast("string").alias("shard"), F.format_string("%09d", "doc_id").alias("key"), F.lit("txt").alias("ext"), F.encode("text", "utf-8").alias("content"))
    folder, listed = _written_shards(spark, members)
    back = _shard_name(shards.read_tar_shards(spark, f"{folder}/*.tar")).groupBy(F.concat("shard", F.lit(".tar")).alias("path")).agg(F.sum(F.length("content")).alias("n_bytes"))
    return listed.join(back, "path").select("path", "n_records", "n_bytes")


def assign_output_shards(spark, d):
    counts = read_table(spark, d, "documents").groupBy(F.col("source").alias("shard")).agg(F.count("*").alias("n"))
    return samples.assign_output_shards(counts, PER_SHARD, WORKERS)


def parse_label(spark, d):
    labels = read_table(spark, d, "labels").select("doc_id", F.concat(F.lit(" "), F.col("quality").cast("string")).alias("text"))
    return labels.select("doc_id", samples.parse_label(F.col("text")).alias("label"))


def sample_key(spark, d):
    names = read_table(spark, d, "documents").select(F.concat(F.format_string("%09d", "doc_id"), F.lit(".txt")).alias("name"))
    key, ext = samples.split_name(F.col("name"))
    return names.select("name", key.alias("key"), ext.alias("ext"), key.cast("bigint").alias("id"))


def _samples(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    m = F.col("doc_id") % 3
    fields = F.map_from_arrays(F.array(F.lit("jpg"), F.lit("png"), F.lit("txt")), F.array(F.when(m == 0, F.col("source")), F.when(m <= 1, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))))
    return docs.withColumn("fields", fields)


def coalesce_fields(spark, d):
    return _samples(spark, d).select("doc_id", samples.first_field("fields", "jpg", "png").alias("image"))


def filter_has_field(spark, d):
    return samples.with_field(_samples(spark, d), "txt").select("doc_id", F.col("fields")["txt"].alias("txt"))


def map_fields(spark, d):
    done = samples.map_fields(_samples(spark, d), {"source": F.upper, "n_chars": lambda c: c % 1000})
    return done.select("doc_id", "source", "n_chars")


def group_members(spark, d):
    # Some members are read twice; the later one stays.
    members = _members(spark, d)
    again = members.where("pos % 2 = 1").withColumns({"content": F.encode(F.lit("again"), "utf-8"), "pos": F.col("pos") + 1000})
    done = samples.group_members(members.union(again))
    return done.select("shard", "key", F.size("fields").alias("n_fields"), F.aggregate(F.map_values("fields"), F.lit(0), lambda s, c: s + F.length(c)).alias("n_bytes"))


def _listed(spark, d):
    labels = read_table(spark, d, "labels")
    return labels.select("doc_id", F.col("quality").alias("cls")).union(labels.where("toxic = 1").select("doc_id", "toxic"))


def select_samples(spark, d):
    return samples.select_samples(read_table(spark, d, "documents"), _listed(spark, d), "doc_id").select("doc_id", "lang", "source")


def select_from_shards(spark, d):
    """Listed samples out of shards: the index is joined first, so that other members are not read."""
    docs = read_table(spark, d, "documents").select(F.col("source").alias("shard"), F.format_string("%09d", "doc_id").alias("key"), F.lit("txt").alias("ext"), F.encode("text", "utf-8").alias("content"))
    folder, _ = _written_shards(spark, docs)
    index = shards.index_tar_shards(spark, f"{folder}/*.tar").where("key IS NOT NULL").withColumn("doc_id", F.col("key").cast("bigint"))
    found = samples.decoded_only(shards.read_members(samples.select_samples(index, _listed(spark, d), "doc_id")))
    return _shard_name(found).select("shard", F.col("key").cast("bigint").alias("doc_id"), F.sha2("content", 256).alias("sha"))


def select_samples_labeled(spark, d):
    return samples.select_labeled(read_table(spark, d, "documents"), _listed(spark, d), "doc_id").select("doc_id", "lang", "cls")


def first_n_ids(spark, d):
    listed = subsets.global_rank(read_table(spark, d, "labels").select("doc_id"), F.desc("doc_id")).select("doc_id", (F.col("rank") - 1).alias("pos"))
    return samples.select_samples(read_table(spark, d, "documents"), samples.first_n(listed, FIRST), "doc_id").select("doc_id", "lang")


def _classes(spark, d):
    return read_table(spark, d, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("class_name"))


def _allowed(spark):
    return spark.createDataFrame([(c,) for c in ALLOWED], "class_id int")


def expand_prompts(spark, d):
    return zeroshot.expand_prompts(_classes(spark, d), spark.createDataFrame(TEMPLATES, "template_id int, template string"))


def class_subset(spark, d):
    return zeroshot.class_subset(_classes(spark, d), _allowed(spark))


def _prototypes(spark, d):
    return zeroshot.class_prototypes(roles.train(spark, d).select(F.col("label").alias("class_id"), "embedding"))


def class_prototypes(spark, d):
    return _prototypes(spark, d).select("class_id", F.posexplode("embedding")).select("class_id", "pos", F.round("col", 6).alias("value"))


def zero_shot_logits(spark, d):
    done = zeroshot.logits(roles.queries(spark, d), _prototypes(spark, d))
    return done.select("id", F.posexplode("logits")).select("id", "pos", F.round("col", 6).alias("logit"))


def zero_shot_predict(spark, d):
    return zeroshot.predict(roles.queries(spark, d), _prototypes(spark, d)).select("id", "pred", F.round("logit", 6).alias("logit"))


def masked_predict(spark, d):
    return zeroshot.masked_predict(roles.queries(spark, d), _prototypes(spark, d), _allowed(spark))


def _scored(spark, d):
    labels = roles.queries(spark, d).select("id", "label")
    return zeroshot.predict(roles.queries(spark, d), _prototypes(spark, d)).join(labels, "id").withColumns({"epoch": F.col("id") % 3, "dataset": F.col("id") % 4})


def accuracy(spark, d):
    return zeroshot.accuracy(_scored(spark, d), "epoch", "dataset").withColumn("accuracy", F.round("accuracy", 6))


def accuracy_resume(spark, d):
    done = zeroshot.accuracy(_scored(spark, d), "epoch", "dataset")
    path = new_path(spark, "accuracies")
    zeroshot.append_accuracies(done.where("epoch = 0").withColumn("accuracy", F.lit(-1.0)), path)
    return zeroshot.append_accuracies(done, path).withColumn("accuracy", F.round("accuracy", 6))


def eval_subset(spark, d):
    rows = read_table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return zeroshot.accuracy(samples.select_samples(_scored(spark, d), rows), "dataset").withColumn("accuracy", F.round("accuracy", 6))


_POS = f"SELECT nr // {CHUNK_ROWS} AS chunk, nr % {CHUNK_ROWS} AS pos, id, e FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS nr, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_M = f"SELECT CAST(conv_id // {TALKS} AS VARCHAR) AS shard, lpad(CAST(conv_id AS VARCHAR), 9, '0') AS key, CAST(turn AS VARCHAR) AS ext, octet_length(CAST(encode(text) AS BLOB)) AS n, turn FROM conversations"
_LISTED = "SELECT doc_id, quality AS cls FROM labels UNION ALL SELECT doc_id, toxic FROM labels WHERE toxic = 1"
_PROTO = f"""{R}, u AS (SELECT label AS class_id, pos, avg(x / len) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos, sqrt(list_dot_product(e, e)) AS len FROM t) GROUP BY label, pos),
c AS MATERIALIZED (SELECT class_id, list(m / len ORDER BY pos) AS c FROM u JOIN (SELECT class_id, sqrt(sum(m * m)) AS len FROM u GROUP BY class_id) USING (class_id) GROUP BY class_id)"""
_PRED = "pr AS (SELECT q.id AS id, any_value(q.label) AS label, arg_max(class_id, list_dot_product(q.e, c.c)) AS pred, max(list_dot_product(q.e, c.c)) AS logit FROM q, c GROUP BY q.id)"
_ACC = "ac AS (SELECT id % 3 AS epoch, id % 4 AS dataset, round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM pr GROUP BY ALL)"
_TEMPLATES = ", ".join(f"({i}, '{t}')" for i, t in TEMPLATES)
_ALLOWED = ", ".join(map(str, ALLOWED))

SQL = {
    "load_embeddings": f"WITH {R} SELECT id, label, CAST(len(e) AS INTEGER) AS dim, round(sqrt(list_dot_product(e, e)), 6) AS length FROM v",
    "read_npy_chunks": f"SELECT chunk, pos, round(sqrt(list_dot_product(e, e)), 6) AS length, round(e[1], 6) AS first FROM ({_POS})",
    "zip_chunk_metadata": f"SELECT chunk, pos, id, round(e[1], 6) AS first FROM ({_POS})",
    "positional_ids": f"SELECT chunk * {BASE_SIZE} + pos AS id, chunk, pos FROM ({_POS})",
    "read_metadata_chunk": f"SELECT 'metadata_' || CASE WHEN chunk < 10 THEN '0' ELSE '' END || chunk || '.parquet' AS file, chunk, count(*) AS n, min(id) AS first_id, max(pos) AS last_pos FROM ({_POS}) GROUP BY chunk",
    "image_folder_index": f"SELECT path, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT source, source || '/' || (doc_id // {PAGE}) || '.txt' AS path FROM documents)",
    "read_tar_shards": f"SELECT DISTINCT shard, key, ext, CAST(n AS INTEGER) AS n_bytes FROM ({_M})",
    "read_tolerant": "SELECT page_id, TRY_CAST(regexp_extract(url, '([0-9]+)/?$', 1) AS BIGINT) AS number FROM pages WHERE TRY_CAST(regexp_extract(url, '([0-9]+)/?$', 1) AS BIGINT) IS NOT NULL",
    "write_tar_shards": f"SELECT s || '.tar' AS path, count(*) AS n_records, CAST(sum(octet_length(CAST(encode(text) AS BLOB))) AS BIGINT) AS n_bytes FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // {PER_SHARD} AS s, text FROM documents) GROUP BY s",
    "assign_output_shards": f"""WITH RECURSIVE c AS (SELECT source AS shard, count(*) AS n FROM documents GROUP BY source), o AS (SELECT shard, n, row_number() OVER (ORDER BY shard) - 1 AS nr FROM c),
d AS (SELECT CAST(nr % {WORKERS} AS INTEGER) AS worker, nr // {WORKERS} AS i, shard, n FROM o),
r AS (SELECT worker, i, shard, n, 0::BIGINT AS out_shard, n AS held FROM d WHERE i = 0
  UNION ALL SELECT d.worker, d.i, d.shard, d.n, CASE WHEN r.held > {PER_SHARD} THEN r.out_shard + 1 ELSE r.out_shard END, CASE WHEN r.held > {PER_SHARD} THEN d.n ELSE r.held + d.n END FROM r JOIN d ON d.worker = r.worker AND d.i = r.i + 1)
SELECT worker, shard, out_shard, n FROM r""",
    "parse_label": "SELECT doc_id, CAST(quality AS INTEGER) AS label FROM labels",
    "sample_key": "SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS name, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key, 'txt' AS ext, doc_id AS id FROM documents",
    "coalesce_fields": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang END AS image FROM documents",
    "filter_has_field": "SELECT doc_id, lang AS txt FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL",
    "map_fields": "SELECT doc_id, upper(source) AS source, n_chars % 1000 AS n_chars FROM documents",
    "group_members": f"SELECT shard, key, CAST(count(DISTINCT ext) AS INTEGER) AS n_fields, CAST(sum(CASE WHEN turn % 2 = 1 THEN 5 ELSE n END) AS INTEGER) AS n_bytes FROM (SELECT shard, key, ext, max(turn) AS turn, max(n) AS n FROM ({_M}) GROUP BY shard, key, ext) GROUP BY shard, key",
    "select_samples": f"SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_LISTED}))",
    "select_samples_labeled": f"SELECT doc_id, lang, cls FROM documents JOIN ({_LISTED}) USING (doc_id)",
    "first_n_ids": f"SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels ORDER BY doc_id DESC LIMIT {FIRST})",
    "expand_prompts": f"SELECT n_nationkey AS class_id, n_name AS class_name, template_id, replace(template, '{{c}}', n_name) AS prompt FROM nation, (VALUES {_TEMPLATES}) AS x(template_id, template)",
    "class_subset": f"SELECT n_nationkey AS class_id, n_name AS class_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS sub_id FROM nation WHERE n_nationkey IN ({_ALLOWED})",
    "class_prototypes": f"WITH {_PROTO} SELECT class_id, CAST(pos - 1 AS INTEGER) AS pos, round(x, 6) AS value FROM (SELECT class_id, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM c)",
    "zero_shot_logits": f"WITH {_PROTO} SELECT q.id AS id, CAST((SELECT count(*) FROM c o WHERE o.class_id < c.class_id) AS INTEGER) AS pos, round(list_dot_product(q.e, c.c), 6) AS logit FROM q, c",
    "zero_shot_predict": f"WITH {_PROTO}, {_PRED} SELECT id, pred, round(logit, 6) AS logit FROM pr",
    "masked_predict": f"WITH {_PROTO}, s AS (SELECT class_id, c, CAST(row_number() OVER (ORDER BY class_id) - 1 AS INTEGER) AS sub_id FROM c WHERE class_id IN ({_ALLOWED})) SELECT q.id AS id, arg_max(sub_id, list_dot_product(q.e, s.c)) AS pred FROM q, s GROUP BY q.id",
    "accuracy": f"WITH {_PROTO}, {_PRED}, {_ACC} SELECT epoch, dataset, accuracy FROM ac",
    "select_from_shards": f"SELECT source AS shard, doc_id, sha256(text) AS sha FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_LISTED}))",
    "accuracy_resume": f"WITH {_PROTO}, {_PRED}, {_ACC} SELECT epoch, dataset, CASE WHEN epoch = 0 THEN -1.0::DOUBLE ELSE accuracy END AS accuracy FROM ac",
    "eval_subset": f"WITH {_PROTO}, {_PRED} SELECT id % 4 AS dataset, round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM pr WHERE id IN (SELECT doc_id FROM labels) GROUP BY id % 4",
}

JOBS = {f.__name__: f for f in (load_embeddings, read_npy_chunks, zip_chunk_metadata, positional_ids, read_metadata_chunk, image_folder_index, read_tar_shards, read_tolerant, write_tar_shards, assign_output_shards, parse_label, sample_key, coalesce_fields, filter_has_field, map_fields, group_members, select_samples, select_from_shards, select_samples_labeled, first_n_ids, expand_prompts, class_subset, class_prototypes, zero_shot_logits, zero_shot_predict, masked_predict, accuracy, accuracy_resume, eval_subset)}
