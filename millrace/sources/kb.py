"""Knowledge-base files: reading their three shapes, writing, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = "struct<question:string,answer:string,is_unified:boolean,is_bucketed:boolean,bucket_id:string>"
TOPIC = (
    f"struct<topic:string,semantic_path:string,original_url:string,browser_content:string,extraction_method:string,processing_time:double,status:string,error:string,"
    f"qa_pairs:array<{PAIR}>,qa_generation_status:string,qa_generation_time:double,qa_model:string,qa_count:int>"
)
ELEMENT = "struct<text:string,element_type:string,original_url:string,parent_url:string,depth:int,content:string>"


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics of a file that holds an array of them, or an envelope {metadata, tree, topics}; ord is their place."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    array = F.from_json("value", f"array<{TOPIC}>")
    envelope = F.from_json("value", f"struct<topics:array<{TOPIC}>>")["topics"]
    both = F.when(F.col("value").startswith("["), array).otherwise(envelope)
    return raw.select("file", F.posexplode(both).alias("ord", "t")).select("file", "ord", "t.*")


def flatten(topics: DataFrame) -> DataFrame:
    """One row a pair, with its place in the topic."""
    return topics.select("ord", "topic", "semantic_path", "original_url", F.posexplode("qa_pairs").alias("qa_index", "p")).select(
        F.col("ord").alias("topic_index"), "qa_index", "topic", "semantic_path", "original_url",
        "p.question", "p.answer", F.coalesce("p.is_bucketed", F.lit(False)).alias("is_bucketed"), "p.bucket_id",
    )


def read_elements(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Semantic elements of a crawl file: below semantic_elements, as a list, or as the bare map from path to element."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    fields = ELEMENT[len("struct<") : -1]
    listed = F.from_json("value", f"array<struct<semantic_path:string,{fields}>>")
    nested = F.from_json("value", f"struct<semantic_elements:map<string,{ELEMENT}>>")["semantic_elements"]
    bare = F.from_json("value", f"map<string,{ELEMENT}>")
    names = [f.split(":")[0] for f in fields.split(",")]
    as_list = raw.where(F.col("value").startswith("[")).select(F.posexplode(listed).alias("ord", "e")).select("ord", "e.semantic_path", *(f"e.{n}" for n in names))
    mapped = raw.where(~F.col("value").startswith("[")).select(F.posexplode(F.coalesce(nested, bare)).alias("ord", "semantic_path", "e"))
    out = as_list.unionByName(mapped.select("ord", "semantic_path", *(f"e.{n}" for n in names)))
    return out.orderBy("ord").limit(limit) if limit else out


def write_topics(topics: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """One JSON document a topic file: the array, or the envelope if there is metadata. Whole files are small by nature: one site's topics."""
    rows = topics.withColumn("file", F.lit(0)) if "file" not in topics.columns else topics
    body = F.struct(*(c for c in topics.columns if c not in ("file", "ord")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", body.alias("t")))), lambda x: x["t"])
    out = rows.groupBy("file").agg(ordered.alias("topics"))
    if metadata is None:
        out = out.select(F.to_json("topics").alias("value"))
    else:
        fields = F.struct(*(F.lit(v).alias(k) for k, v in metadata.items()))
        out = out.select(F.to_json(F.struct(fields.alias("metadata"), F.lit(None).cast("string").alias("tree"), "topics")).alias("value"))
    out.write.mode("overwrite").text(path)


class Snapshots:
    """Versions of a table, each in a folder of its own; a version is never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = (s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v"))
        return sorted(int(p.getName()[1:]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def save(self, rows: DataFrame, note: str = "") -> int:
        version = (self.versions() or [0])[-1] + 1
        rows.withColumn("__note", F.lit(note)).write.parquet(f"{self.path}/v{version:06d}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or self.versions()[-1]:06d}").drop("__note")

    def rollback(self, version: int) -> int:
        """A new version with the rows of an old one."""
        return self.save(self.read(version), f"rollback to {version}")


def listing(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files below a folder: name, kb (two decimals), modified; newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.bround(F.col("length") / 1024, 2).alias("kb"), F.col("modificationTime").alias("modified")).where(~F.col("name").isin(*exclude) if exclude else F.lit(True)).orderBy(F.desc("modified"), "name")


def checked(spark: SparkSession, path: str) -> DataFrame:
    """What is wrong with topic files, one row each: file, topics, problem (null for a good one)."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.trim("value").alias("value"))
    whole = F.try_parse_json("value")
    listed = F.coalesce(F.try_variant_get(whole, "$.topics", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))
    good = lambda t: F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(t, "$.qa_pairs", "variant")), F.lit("ARRAY<")), F.lit(False))
    bad = F.filter(F.transform("listed", lambda t, k: F.when(~good(t), k)), lambda k: k.isNotNull())
    out = raw.select("file", whole.isNull().alias("broken"), listed.alias("listed"))
    problem = (
        F.when(F.col("broken"), "not JSON")
        .when(F.col("listed").isNull(), "neither a list of topics nor an object with topics")
        .when(F.size("listed") == 0, "no topics")
        .when(F.size(bad) > 0, F.concat(F.lit("no list of pairs in topic "), F.get(bad, F.lit(0)).cast("string")))
    )
    return out.select("file", F.size("listed").alias("topics"), problem.alias("problem"))


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder by their ending: files, kb (two decimals), newest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    kind = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.bround(F.sum("length") / 1024, 2).alias("kb"), F.max("modificationTime").alias("newest"))


def write_elements(elements: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """A crawl's elements as one JSON document of a map from path to element; of equal paths the last in ord counts. read_elements() reads it."""
    fields = [f.split(":")[0] for f in ELEMENT[len("struct<") : -1].split(",")]
    last = elements.groupBy("semantic_path").agg(F.max_by(F.struct(*fields), "ord").alias("e"), F.max("ord").alias("at"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "semantic_path", "e"))), lambda x: F.struct(x["semantic_path"], x["e"]))
    known = F.struct(*(F.lit(v).alias(k) for k, v in (metadata or {"crawl_type": "hierarchical"}).items()))
    last.agg(ordered.alias("m")).select(F.to_json(F.struct(known.alias("crawl_metadata"), F.map_from_entries("m").alias("semantic_elements"))).alias("value")).write.mode("overwrite").text(path)


EVAL_CASES = T.StructType([T.StructField("original_question", T.StringType()), T.StructField("rephrased_question", T.StringType())])


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=EVAL_CASES, multiLine=True, escape='"')


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def tree_of(embedded: DataFrame | None, sibling: DataFrame | None, recent: DataFrame | None) -> DataFrame | None:
    """The first tree that has a row: the file's own, that of the file beside it, the most recent one."""
    for tree in (embedded, sibling, recent):
        if tree is not None and tree.limit(1).count():
            return tree
    return None


def write_tree(nodes: DataFrame, path: str, domain: str) -> None:
    """Nodes (ord, parent_ord, title, path, url, depth) as one JSON document {domain, total_nodes, tree}; children by depth, then path.

    The nodes of one site; the nesting is made of one level after the other, from the leaves up.
    """
    rows = nodes.select("ord", "parent_ord", "title", "path", "url", "depth")
    levels = [r["depth"] for r in rows.select("depth").distinct().orderBy(F.desc("depth")).collect()]  # a row a level
    below, total = None, rows.agg(F.count("*").alias("total"))
    for depth in levels:
        own = rows.where(F.col("depth") == depth)
        if below is None:
            own = own.withColumn("children", F.lit("[]"))
        else:
            own = own.join(below, own["ord"] == below["up"], "left").withColumn("children", F.coalesce("children", F.lit("[]")))
        text = F.concat(F.regexp_replace(F.to_json(F.struct("title", "path", "url", "depth")), r"\}$", ""), F.lit(',"children":'), "children", F.lit("}"))
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "ord", text.alias("t")))), lambda x: x["t"]), ",")
        top = own.where("parent_ord is null").select(F.lit(None).cast("long").alias("up"), "path", "ord", text.alias("t"))
        below = own.groupBy(F.col("parent_ord").alias("up")).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("children"))
    tree = below.where("up is null").select("children") if below is not None else None
    body = F.concat(F.regexp_replace(F.to_json(F.struct(F.lit(domain).alias("domain"), F.col("total").alias("total_nodes"))), r"\}$", ""), F.lit(',"tree":'), F.col("children") if tree is not None else F.lit("[]"), F.lit("}"))
    (total if tree is None else total.crossJoin(tree)).select(body.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """The upper level of a tree file: title, path, url, depth, and children as JSON."""
    raw = spark.read.text(path, wholetext=True)
    node = "array<struct<title:string,path:string,url:string,depth:int,children:string>>"
    return raw.select(F.explode(F.from_json(F.get_json_object("value", "$.tree"), node)).alias("n")).select("n.*")


def write_crawl(pages: DataFrame, path: str, stats: dict[str, str]) -> None:
    """A breadth-first crawl: a JSON line a page below pages, and one of figures below stats."""
    pages.write.mode("overwrite").json(f"{path.rstrip('/')}/pages")
    pages.agg(F.count("*").alias("total_pages"), *(F.lit(v).alias(k) for k, v in stats.items())).write.mode("overwrite").json(f"{path.rstrip('/')}/stats")


def preview(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The metadata of the first of some crawl files that is there: crawl_type and the number of elements; no contents."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            raw = spark.read.text(p, wholetext=True)
            count = F.size(F.json_object_keys(F.get_json_object("value", "$.semantic_elements")))
            return raw.select(F.lit(p).alias("file"), F.get_json_object("value", "$.crawl_metadata.crawl_type").alias("crawl_type"), count.alias("elements"))
    return None


class Base:
    """The knowledge-base file in use; it can be switched, and others deleted, with what was made from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.switch(path)

    def switch(self, path: str) -> DataFrame:
        """Read another file and refresh what is cached of it."""
        self.spark.catalog.refreshByPath(path)
        self.path, self.topics = path, read_topics(self.spark, path)
        return self.topics

    def reload(self) -> DataFrame:
        return self.switch(self.path)

    def delete(self, path: str, caches: tuple[str, ...] = ()) -> None:
        """Delete a file and its caches; the file in use can't be."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        own = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        if own(path).getFileSystem(conf).makeQualified(own(path)).equals(own(self.path).getFileSystem(conf).makeQualified(own(self.path))):
            raise ValueError("the file is in use")
        for p in (path, *caches):
            own(p).getFileSystem(conf).delete(own(p), True)
