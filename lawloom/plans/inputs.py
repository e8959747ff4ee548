"""Input tables of the registered queries, derived by Spark from whole driver tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators import versions as V


TEXT_TABLES = ("documents", "pages", "conversations", "embeddings")
SPREAD = "spark.lawloom.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with the splits of its files. Where files are too few to split (one row group each), the session
    may ask for a number of partitions by the setting above, as local sessions do."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get(SPREAD, None)
    return df.repartition(int(spread)) if spread and name in TEXT_TABLES else df


# Line rules shared with the SQL twins: {i} is the line number from 0, {div} integer division.
DIRTY_LINE = """
concat(
  CASE WHEN {i} % 6 = 2 THEN '- ' ELSE '' END,
  CASE WHEN {i} % 7 = 4 THEN concat({tab}, '  ', x) WHEN {i} % 11 = 5 THEN concat(x, {nbsp}, ' ') ELSE
    CASE WHEN {i} % 2 = 1 THEN regexp_replace(x, '[.]$', '') ELSE x END END,
  CASE WHEN {i} % 3 = 1 THEN {cr} ELSE '' END,
  CASE WHEN {i} % 5 = 0 THEN concat({nl}, {nl}) ELSE '' END,
  CASE WHEN {i} % 9 = 8 THEN concat({nl}, CAST({i} AS {text})) ELSE '' END)
"""

LEGAL_LINE = """
CASE WHEN doc_id % 13 = 7 THEN x
WHEN doc_id % 11 = 6 THEN concat_ws({nl},
  CASE WHEN {i} % 3 = 0 THEN concat(CAST({i} {div} 3 + 1 AS {text}), CASE WHEN {i} % 6 = 3 THEN '.1 ' ELSE '. ' END,
                                    left(x, 30)) END, x)
ELSE concat_ws({nl},
  CASE WHEN {i} % 12 = 0 THEN concat('Chương ', CAST({i} {div} 12 + 1 AS {text})) END,
  CASE WHEN {i} = 9 AND doc_id % 3 = 0 THEN 'Phụ lục II' END,
  CASE WHEN {i} % 4 = 0 THEN concat('Điều ', CAST({i} {div} 4 + 1 AS {text}), '. ', left(x, 30)) END,
  CASE WHEN doc_id % 5 = 0 AND {i} % 7 = 3 THEN concat('1. Sửa đổi khoản 2 Điều ', CAST({i} {div} 7 + 1 AS {text})) END,
  CASE WHEN doc_id % 7 = 2 AND {i} % 8 = 5 THEN 'Bãi bỏ điểm a khoản 3 Điều 9' END,
  CASE WHEN {i} % 4 = 2 THEN concat('2. ', left(x, 40)) END,
  CASE WHEN doc_id % 4 = 1 AND {i} % 4 = 3 THEN 'theo Phụ lục 2 và Phụ lục III' END,
  x) END
"""


def _per_line(df: DataFrame, rule: str) -> DataFrame:
    expr = rule.format(
        i="i", div="div", text="string", nl="'\\n'", tab="'\\t'", cr="'\\r'", nbsp="'\u00a0'"
    )
    text = F.expr(f"array_join(transform(split(text, '\\n'), (x, i) -> {expr}), '\\n')")
    return df.withColumn("text", text)


def dirty(spark, sf_dir) -> DataFrame:
    return _per_line(table(spark, sf_dir, "documents"), DIRTY_LINE)


def legal_lines(documents: DataFrame) -> DataFrame:
    return _per_line(documents, LEGAL_LINE)


def legal(spark, sf_dir) -> DataFrame:
    return legal_lines(table(spark, sf_dir, "documents"))


def plain_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


# --- versions ------------------------------------------------------------------------


def uploads(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("documents/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.col("source").alias("document_id"),
        F.col("doc_id").cast("string").alias("version_id"),
        F.col("doc_id").alias("upload_no"),
        F.when(F.col("doc_id") % 13 != 0, path).alias("source_file_path"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(path, F.lit(".raw"))).alias("raw_text_path"),
        F.lit(None).cast("string").alias("cleaned_text_path"),
        F.lit(None).cast("string").alias("layout_json_path"),
        F.lit("pending").alias("status"),
    )


def versions(spark, sf_dir) -> DataFrame:
    return V.link_versions(uploads(spark, sf_dir))


def document_table(spark, sf_dir) -> DataFrame:
    """One row per source; sources whose document ids sum to a multiple of 7 are missing."""
    d = table(spark, sf_dir, "documents")
    return (
        d.groupBy("source")
        .agg(F.sum("doc_id").alias("s"))
        .filter("s % 7 <> 0")
        .select(
            F.col("source").alias("document_id"),
            F.concat(F.lit("Title "), "source").alias("title"),
            F.when(F.col("s") % 2 == 0, "web").alias("source_type"),
            F.lit("text/plain").alias("mime_type"),
            F.lit("active").alias("status"),
        )
    )


# --- points and questions ------------------------------------------------------------

_KIND = "CASE label % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'appendix' ELSE 'amendment' END"


def points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    p = e.select(
        F.col("vec_id").alias("id"),
        "embedding",
        "label",
        (F.col("vec_id") % 20).cast("string").alias("document_id"),
        F.expr(_KIND).alias("chunk_kind"),
        (F.col("label") % 2 == 0).cast("string").alias("is_amendment"),
        F.col("label").cast("string").alias("article_number"),
    )
    return p.join(d, "id", "left")


def query_vectors(spark, sf_dir, k: int = 8) -> DataFrame:
    """Three expanded queries per label: the mean vector of all, of the even and of the odd members."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", array_to_vector("embedding"))
    whole = e.select("label", F.lit(0).alias("query_index"), "v")
    half = e.select("label", (F.col("vec_id") % 2 + 1).cast("int").alias("query_index"), "v")
    means = whole.unionByName(half).groupBy("label", "query_index").agg(Summarizer.mean(F.col("v")).alias("m"))
    filters = F.expr(
        "CASE label % 3 WHEN 1 THEN map('is_amendment', 'true') WHEN 2 THEN map('chunk_kind', 'amendment') "
        "ELSE CAST(map() AS map<string,string>) END"
    )
    return means.select(
        F.col("label").cast("bigint").alias("query_id"),
        "query_index",
        vector_to_array("m").alias("vector"),
        F.lit(k).alias("k"),
        filters.alias("filters"),
    )


# --- conversations -------------------------------------------------------------------


def messages(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 1000 + F.col("turn") * 10)
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("conv_id").alias("session_id"),
        "role",
        F.col("text").alias("content"),
        at.cast("timestamp").alias("created_at"),
        "turn",
    )


def sessions(spark, sf_dir) -> DataFrame:
    m = messages(spark, sf_dir)
    s = m.groupBy("session_id").agg(
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        F.min_by("content", "turn").alias("first"),
    )
    sid = F.col("session_id")
    return s.select(
        "session_id",
        (sid % 10).alias("user_id"),
        F.when(sid % 4 != 0, F.left("first", F.lit(40))).alias("title"),
        "created_at",
        "updated_at",
        F.when(sid % 9 == 0, F.col("updated_at")).alias("deleted_at"),
    )


def traces(spark, sf_dir) -> DataFrame:
    m = messages(spark, sf_dir).filter("role = 'assistant'")
    e = table(spark, sf_dir, "events")
    n = e.agg(F.count("*").alias("n")).first()["n"]
    key = ((F.col("session_id") * 10 + F.col("turn")) % F.lit(n)).alias("event_id")
    route = F.when(F.col("event_type") != "signup", F.col("event_type"))
    return m.select("message_id", key).join(e, "event_id").select(
        "message_id", route.alias("route"), (F.col("value") * 10).cast("int").alias("latency_ms")
    )


def feedback(spark, sf_dir) -> DataFrame:
    """Feedback on assistant messages; every tenth session gives its feedback twice."""
    m = messages(spark, sf_dir).filter("role = 'assistant'")
    sid, turn = F.col("session_id"), F.col("turn")
    rows = m.select(
        F.col("message_id"),
        (sid % 10).alias("user_id"),
        (1 + (sid * 7 + turn * 3) % 5).cast("int").alias("rating"),
        F.expr("CASE turn % 4 WHEN 1 THEN 'incorrect' WHEN 2 THEN 'outdated' WHEN 3 THEN 'unclear' END").alias("reason"),
        F.expr("CASE session_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'reviewed' ELSE 'resolved' END").alias("admin_status"),
        F.when(turn % 2 == 1, F.lit("seen")).alias("admin_note"),
        F.lit(None).cast("bigint").alias("reviewed_by"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        (F.col("created_at") + F.expr("INTERVAL 5 SECONDS")).alias("created_at"),
        F.explode(F.expr("CASE WHEN session_id % 10 = 0 THEN array(0, 1) ELSE array(0) END")).alias("again"),
    )
    return rows.withColumn("feedback_id", F.col("message_id") * 10 + F.col("again")).withColumn(
        "rating", F.when(F.col("again") == 1, 5).otherwise(F.col("rating"))
    )


def jobs(spark, sf_dir) -> DataFrame:
    """Job states over time: ten jobs per user, one state per event."""
    e = table(spark, sf_dir, "events")
    status = (
        "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' "
        "ELSE 'completed' END"
    )
    return e.select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("job_id"),
        F.col("user_id").alias("document_id"),
        "event_id",
        F.expr(status).alias("status"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"),
        "ts",
        (F.col("event_type") == "error").alias("failed"),
    )


# --- directory, layout, uploads, questions -------------------------------------------


def directory_documents(spark, sf_dir, per_document: int = 50) -> DataFrame:
    """Directory texts of 50 customers each; some lack a name, some everything else."""
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey")
    bare = key % 13 == 0
    line = lambda label, value, when: F.when(when, F.concat(F.lit(label), value))
    block = F.concat_ws(
        "\n",
        line("Đơn vị: ", F.col("n_name"), ~bare),
        line("Tên: ", F.col("c_name"), key % 11 != 0),
        line("Thông tin: ", F.col("c_mktsegment"), ~bare),
        line("Điện thoại: ", F.concat(F.lit("0"), key.cast("string")), ~bare),
        line("Email: ", F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.com")), ~bare),
    )
    blocks = c.select(F.expr(f"c_custkey div {per_document}").alias("doc_id"), "c_custkey", block.alias("block"))
    return blocks.groupBy("doc_id").agg(
        F.concat(
            F.lit("Thông tin giảng viên\n=====\n"),
            F.expr("listagg(block, '\\n=====\\n') WITHIN GROUP (ORDER BY c_custkey)"),
        ).alias("text")
    )


def layout_rows(spark, sf_dir) -> DataFrame:
    """Layout entries of every document: each line, and its first half."""
    lines = plain_lines(table(spark, sf_dir, "documents"))
    y = (F.col("line_no") % 10 * 10).cast("double")
    full = lines.select(
        "doc_id", "line_no", F.lit(0).alias("half"), F.col("line").alias("text"),
        F.array(F.lit(0.0), y, F.lit(500.0), y + 9).alias("bbox"),
    )
    half = lines.select(
        "doc_id", "line_no", F.lit(1).alias("half"),
        F.expr("left(line, CAST(length(line) div 2 AS INT))").alias("text"),
        F.array(F.lit(0.0), y, F.lit(250.0), y + 9).alias("bbox"),
    )
    size = F.struct(F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return full.unionByName(half).select(
        "doc_id", "line_no", "half", "text", "bbox", F.expr("line_no div 10").cast("int").alias("page_idx"),
        size.alias("page_size"),
    )


def layout_json(lines: DataFrame, spans: Column) -> DataFrame:
    """(doc_id, layout): lines as layout JSON, ten lines a page, one block a line with the given spans."""
    y = (F.col("line_no") % 10 * 10).cast("double")
    bbox = F.array(F.lit(0.0), y, F.lit(500.0), y + 9)
    block = F.struct(bbox.alias("bbox"), F.array(F.struct(bbox.alias("bbox"), spans.alias("spans"))).alias("lines"))
    pages = (
        lines.withColumn("block", block)
        .groupBy("doc_id", F.expr("CAST(line_no div 10 AS INT)").alias("page_idx"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "block"))).alias("b"))
    )
    size = F.array(F.lit(595.0), F.lit(842.0)).alias("page_size")
    page = F.struct("page_idx", size, F.transform("b", lambda x: x["block"]).alias("para_blocks"))
    per_doc = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", page.alias("p")))).alias("ps"))
    info = F.transform("ps", lambda x: x["p"])
    return per_doc.select("doc_id", F.to_json(F.struct(info.alias("pdf_info"))).alias("layout"))


QUESTION_TAIL = """
CASE turn % 8 WHEN 0 THEN concat(text, ' Điều ', CAST(conv_id % 30 AS {text}), ' quy định gì')
WHEN 2 THEN concat(text, ' Phụ lục ', CAST(conv_id % 9 + 1 AS {text}))
WHEN 4 THEN CASE conv_id % 3 WHEN 0 THEN concat(text, ' nội dung sửa đổi') WHEN 1 THEN 'xin' ELSE
  concat(text, ' biểu mẫu tuyển sinh') END
WHEN 6 THEN CASE conv_id % 3 WHEN 0 THEN concat('danh sách giảng viên khoa ', text) WHEN 1 THEN
  concat('email của ', text) ELSE concat('quy định giảng viên ', text) END
ELSE text END
"""

MODEL_ANSWER = """
CASE conv_id % 9
WHEN 0 THEN '{open}"strategy":"exact_legal_lookup","article_number":"7","confidence":0.9{close}'
WHEN 1 THEN 'route: {open}"strategy":"appendix_lookup","appendix_number":"ii","confidence":0.6{close} ok'
WHEN 2 THEN '[1, 2]'
WHEN 3 THEN 'no idea'
WHEN 4 THEN '{open}"strategy":"lecturer_lookup","confidence":0.7{close}'
WHEN 5 THEN '{open}"strategy":"amendment_lookup","article_number":"null","confidence":"abc"{close}'
WHEN 6 THEN '{open}"strategy":"low_context_or_invalid","confidence":1.7{close}'
WHEN 7 THEN '{open}"strategy":"broad_semantic_rag","confidence":0.5{close}'
ELSE '{open}"strategy":"amendment_lookup","article_number":"5A","confidence":0.85{close}' END
"""


def questions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select(
        "conv_id",
        "turn",
        F.expr(QUESTION_TAIL.format(text="string")).alias("question"),
        F.expr(MODEL_ANSWER.format(open="{", close="}")).alias("model_answer"),
    )


def upload_files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mime = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png' ELSE "
        "'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END"
    )
    name = F.when(F.col("doc_id") % 17 != 0, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).otherwise("")
    size = F.when(F.col("doc_id") % 19 == 0, F.lit(0)).otherwise(F.col("n_chars") * 4000)
    return d.select("doc_id", mime.alias("mime_type"), name.alias("file_name"), size.cast("bigint").alias("bytes"))
