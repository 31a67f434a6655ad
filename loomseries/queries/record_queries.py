"""Record operators on the given tables: filters, keyed combinations, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import calls
from ..operators import records as rec
from ..plans.numbering import global_rank, time_then_id
from ..plans.series import Series
from ..sources import files
from .tables import rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


# -- calls: every event is a call of a step, with tokens in its JSON properties
STEPS = {
    "click": "api_Operation_Map_build", "view": "structured_doc_writer", "signup": "TEST_DESIGNER",
    "purchase": "test_coder_v2", "error": "ping",
}
STEP_SQL = """CASE event_type WHEN 'click' THEN 'operation_map' WHEN 'view' THEN 'function_documentation'
  WHEN 'signup' THEN 'test_designer' WHEN 'purchase' THEN 'test_coder' ELSE 'other' END"""
CALLS_SQL = f"""calls AS (SELECT {STEP_SQL} AS step, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"""


def _calls(spark, d):
    context = F.lit(None).cast("string")
    for kind, name in STEPS.items():
        context = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(context)
    tokens = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(rec.classify_context(context).alias("step"), tokens.alias("tokens"))


@query("calls_by_step", f"""WITH {CALLS_SQL} SELECT step, CAST(sum(tokens) AS BIGINT) AS input_tokens,
  count(*) AS api_calls, round(avg(tokens), 2) AS avg_tokens_per_call FROM calls GROUP BY ROLLUP (step)""")
def calls_by_step(spark, d):
    return rec.token_rollup(_calls(spark, d))


@query("calls_step_counts", f"WITH {CALLS_SQL} SELECT step, count(*) AS n FROM calls GROUP BY step")
def calls_step_counts(spark, d):
    return _calls(spark, d).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query("calls_additive_upsert", f"""WITH {CALLS_SQL}, m AS (
  SELECT role AS step, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS tokens FROM conversations
  UNION ALL SELECT step, tokens FROM calls)
  SELECT step, CAST(sum(tokens) AS BIGINT) AS input_tokens, count(*) AS calls FROM m GROUP BY step""")
def calls_additive_upsert(spark, d):
    def counted(df):
        return df.groupBy("step").agg(F.sum("tokens").alias("input_tokens"), F.count(F.lit(1)).alias("calls"))

    talk = table(spark, d, "conversations").select(F.col("role").alias("step"), tx.word_count_of(F.col("text")).alias("tokens"))
    return rec.additive_upsert(counted(talk), counted(_calls(spark, d)), "step", ["input_tokens", "calls"])


@query("message_cost", """SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '\\S+'))) + 4 * count(*) + 3 AS BIGINT)
  AS tokens FROM conversations GROUP BY conv_id""")
def message_cost(spark, d):
    return rec.message_cost(table(spark, d, "conversations"), "conv_id", tx.word_count_of(F.col("text")))


@query("call_ratio", f"WITH {CALLS_SQL} SELECT round(count(*) FILTER (step = 'test_coder') * 1.0 / nullif(count(*) FILTER (step = 'test_designer'), 0), 6) AS ratio FROM calls")
def call_ratio(spark, d):
    out = rec.count_ratio(_calls(spark, d), F.col("step") == "test_coder", F.col("step") == "test_designer", "ratio")
    return rounded(out, ["ratio"])


# -- validation records: the events of a user are the runs of one test
KIND_SQL = """CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN 'compilation' WHEN 'signup' THEN 'assertion'
  WHEN 'purchase' THEN 'memory' ELSE 'crash' END"""
INFO_SQL = f"""runs AS (SELECT user_id, ts, event_id, event_type, {KIND_SQL} AS kind FROM events),
info AS (SELECT user_id, first(kind ORDER BY ts, event_id) AS initial_failure_type,
  count(*) FILTER (event_type = 'error') AS total_iterations,
  CASE WHEN last(event_type ORDER BY ts, event_id) = 'error' THEN 'FAIL' ELSE 'PASS' END AS final_status
  FROM runs GROUP BY user_id)"""


def _runs(spark, d):
    """Each event as a run with the output a failing run of that kind would print."""
    kind = F.col("event_type")
    output = F.when(kind == "signup", "Expected 1 but got 2").when(kind == "purchase", "==1== AddressSanitizer: heap")
    output = output.when(kind == "error", "signal 11").otherwise("")
    return table(spark, d, "events").select(
        "user_id", "event_type", time_then_id("ts", "event_id").alias("at"),
        rec.classify_failure(kind == "view", kind.isin("signup", "purchase", "error"), output).alias("kind"))


KINDS = ["none", *rec.FAILURE_TYPES]


def _info(spark, d):
    # Numbers and flags are updated in place, so this stays a hash aggregate; text would make it sort the runs.
    listed = F.array(*[F.lit(k) for k in KINDS])
    runs = _runs(spark, d).select(
        "user_id", "at", F.array_position(listed, F.col("kind")).cast("int").alias("code"),
        (F.col("event_type") == "error").alias("wrong"))
    grouped = runs.groupBy("user_id").agg(
        F.min_by("code", "at").alias("code"), F.count_if("wrong").alias("total_iterations"),
        F.max_by("wrong", "at").alias("wrong"))
    return grouped.select(
        "user_id", F.element_at(listed, F.col("code")).alias("initial_failure_type"), "total_iterations",
        F.when(F.col("wrong"), "FAIL").otherwise("PASS").alias("final_status"))


@query("run_failure_kinds", f"WITH {INFO_SQL} SELECT kind, count(*) AS n FROM runs GROUP BY kind")
def run_failure_kinds(spark, d):
    return _runs(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("validation_info", f"WITH {INFO_SQL} SELECT * FROM info")
def validation_info(spark, d):
    return _info(spark, d)


@query("validation_summary", f"""WITH {INFO_SQL} SELECT count(*) AS total, count(*) FILTER (final_status = 'PASS') AS passed,
  count(*) FILTER (final_status <> 'PASS') AS failed, count(*) FILTER (initial_failure_type <> 'none') AS needed_repair,
  count(*) FILTER (initial_failure_type <> 'none' AND final_status = 'PASS') AS repaired,
  count(*) FILTER (initial_failure_type = 'none' AND final_status = 'PASS') AS passed_initially FROM info""")
def validation_summary(spark, d):
    return rec.validation_summary(_info(spark, d))


@query("repairs_by_iteration", f"""WITH {INFO_SQL} SELECT total_iterations, count(*) AS repaired FROM info
  WHERE initial_failure_type <> 'none' AND final_status = 'PASS' GROUP BY total_iterations""")
def repairs_by_iteration(spark, d):
    return rec.repairs_by_iteration(_info(spark, d))


@query("repairs_by_failure", f"""WITH {INFO_SQL} SELECT failure_type, count(user_id) AS repaired
  FROM (VALUES ('compilation'), ('assertion'), ('crash'), ('memory'), ('timeout')) AS t(failure_type)
  LEFT JOIN info ON initial_failure_type = failure_type AND final_status = 'PASS' GROUP BY failure_type""")
def repairs_by_failure(spark, d):
    return rec.repairs_by_failure(_info(spark, d))


@query("passed_only", f"WITH {INFO_SQL} SELECT user_id FROM info WHERE final_status = 'PASS'")
def passed_only(spark, d):
    return _info(spark, d).filter(F.coalesce(F.col("final_status") == "PASS", F.lit(False))).select("user_id")


# -- predicates and names
@query("filter_public", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filter_public(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return rec.only_known(docs, table(spark, d, "labels"), "doc_id", all_if_empty=True)


@query("filter_non_empty", "SELECT item_id FROM benchmark WHERE trim(text) <> '' AND len(regexp_extract_all(text, '\\S+')) > 0")
def filter_non_empty(spark, d):
    df = table(spark, d, "benchmark")
    return df.filter((F.trim("text") != "") & (F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) > 0)).select("item_id")


@query("filter_test_files", """WITH s AS (SELECT page_id, 'p' || page_id // 6 AS subject, page_id % 3 = 0 OR page_id // 6 % 2 = 0 AS deep,
    CASE WHEN page_id % 5 = 0 THEN 'test_' ELSE 'file_' END || page_id || '.c' AS file, html FROM pages),
  whole AS (SELECT *, bool_and(deep) OVER (PARTITION BY subject) AS inner_only FROM s)
  SELECT subject, subject || CASE WHEN deep THEN '/src/' ELSE '/' END || file AS path, length(html) AS size FROM whole
  WHERE (NOT deep OR inner_only) AND NOT starts_with(file, 'test')""")
def filter_test_files(spark, d):
    """Pages as sources of subjects: in the subject's folder, or under src, which counts where there are no others; tests are left out."""
    subject = F.concat(F.lit("p"), F.expr("page_id div 6"))
    deep = F.expr("page_id % 3 = 0 or page_id div 6 % 2 = 0")
    file = F.concat(F.when(F.col("page_id") % 5 == 0, "test_").otherwise("file_"), F.col("page_id"), F.lit(".c"))
    path = F.concat(subject, F.when(deep, "/src/").otherwise("/"), file)
    sources = table(spark, d, "pages").select(path.alias("path"), F.col("html").alias("text"))
    return files.subject_sources(sources).select("subject", "path", F.length("text").alias("size"))


for _label, _spec, _where in (
    ("all", "all", "true"), ("from", "30+", "p_size >= 30"), ("range", "10-20", "p_size BETWEEN 10 AND 20"),
    ("list", "3,7,49", "p_size IN (3, 7, 49)"),
):
    query(f"select_{_label}", f"SELECT p_partkey, p_size FROM part WHERE {_where}")(
        lambda spark, d, spec=_spec: table(spark, d, "part").select("p_partkey", "p_size").filter(rec.selected(F.col("p_size"), spec)))


@query("wildcard_names", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^s.*g$')")
def wildcard_names(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").filter(rec.wildcard(F.col("p_name"), "s*g"))


@query("safe_names", """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g'),
  '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM pages""")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", rec.safe_name(F.col("url")).alias("name"))


@query("suffixed_names", """SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '_' || (k - 1) END AS file FROM (
  SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)""")
def suffixed_names(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return rec.with_suffix(parts, "p_name", "p_partkey", 100_000, "file").select("p_partkey", "file")


@query("evolved_records", """SELECT s_suppkey, s_name || '!' AS name, s_acctbal * 2 AS balance FROM supplier""")
def evolved_records(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).alias("r"))
    changed = F.col("r").withField("name", F.concat("r.name", F.lit("!"))).withField("balance", F.col("r.balance") * 2)
    return df.select("s_suppkey", changed.alias("r")).select("s_suppkey", "r.*")


@query("rendered_lines", """SELECT c_custkey, concat_ws(chr(10), nullif(c_name, ''),
  CASE WHEN c_acctbal > 0 THEN 'in credit' END, c_mktsegment) AS text FROM customer""")
def rendered_lines(spark, d):
    credit = F.when(F.col("c_acctbal") > 0, "in credit").otherwise("")
    return table(spark, d, "customer").select(
        "c_custkey", rec.non_empty_lines(F.col("c_name"), credit, F.col("c_mktsegment")).alias("text"))


# -- keyed combinations
@query("join_paths", """SELECT o_orderkey AS name, o_orderstatus AS paths, deps, c_name AS signature
  FROM orders JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS deps FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 5000""")
def join_paths(spark, d):
    paths = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), "o_custkey", F.col("o_orderstatus").alias("paths"))
    deps = rec.sorted_set(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "deps").withColumnRenamed("l_orderkey", "name")
    people = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("signature"))
    return paths.join(deps, "name").join(people, "o_custkey", "left").drop("o_custkey")


@query("upsert_paths", """WITH n AS (SELECT l_partkey AS name, max(l_extendedprice) AS price FROM lineitem WHERE l_quantity > 45 GROUP BY 1
  UNION ALL SELECT -1 - s_suppkey, s_acctbal FROM supplier)
  SELECT coalesce(p_partkey, name) AS name, p_brand, CASE WHEN name IS NOT NULL THEN price ELSE p_retailprice END AS price
  FROM part FULL JOIN n ON name = p_partkey""")
def upsert_paths(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("name"), "p_brand", F.col("p_retailprice").alias("price"))
    new = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("name")).agg(F.max("l_extendedprice").alias("price"))
    extra = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("name"), F.col("s_acctbal").alias("price"))
    return rec.upsert(old, new.unionByName(extra), "name", ["price"])


@query("latest_entries", """SELECT n AS name, r.p_partkey, r.p_retailprice FROM (SELECT DISTINCT p_name AS n FROM part UNION ALL
  SELECT n_name FROM nation) LEFT JOIN (SELECT p_name, max(p_partkey) AS p_partkey, arg_max(p_retailprice, p_partkey) AS p_retailprice
  FROM part GROUP BY 1) r ON r.p_name = n""")
def latest_entries(spark, d):
    parts = table(spark, d, "part")
    names = parts.select(F.col("p_name").alias("name")).distinct().unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name")))
    catalog = parts.select(F.col("p_name").alias("name"), "p_partkey", "p_retailprice")
    return rec.latest_or_name(names, catalog, "name", "p_partkey", ["p_partkey", "p_retailprice"])


@query("call_templates", """SELECT o_orderkey, n_name AS template FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey""")
def call_templates(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    homes = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return orders.join(homes, "c_custkey").join(table(spark, d, "nation"), "n_nationkey").select("o_orderkey", F.col("n_name").alias("template"))


@query("documented_functions", """SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, lang) AS note
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def documented_functions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("note"))
    notes = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("note"))
    return rec.left_update(docs, notes, "doc_id", "note")


_KNOWN_SQL = """SELECT p_partkey, p_name, quantity FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS quantity
  FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""


def _known(spark, d, names):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    notes = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    return rec.attach_known(parts, notes, names, "p_partkey")


@query("attached_known", _KNOWN_SQL + " WHERE p_partkey IN (SELECT s_suppkey FROM supplier)")
def attached_known(spark, d):
    return _known(spark, d, table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey")))


@query("attached_all", _KNOWN_SQL)
def attached_all(spark, d):
    """No names: every part stays."""
    return _known(spark, d, table(spark, d, "supplier").filter("s_suppkey < 0").select(F.col("s_suppkey").alias("p_partkey")))


@query("known_calls", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def known_calls(spark, d):
    names = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return rec.only_known(table(spark, d, "orders").select("o_orderkey"), names, "o_orderkey")


@query("unknown_references", """SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN
  (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') AND o_custkey NOT IN (1, 2, 3)""")
def unknown_references(spark, d):
    used = table(spark, d, "orders").select("o_custkey").distinct()
    known = table(spark, d, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return rec.unknown_references(used, known, "o_custkey", [1, 2, 3])


@query("missing_required", """SELECT l_orderkey, list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(f, x))) AS missing
  FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1) WHERE len(f) < 3""")
def missing_required(spark, d):
    have = rec.sorted_set(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "f")
    need = F.array(*[F.lit(x) for x in "ANR"])
    return have.select("l_orderkey", F.sort_array(rec.missing_required(need, F.col("f"))).alias("missing")).filter(F.size("missing") > 0)


@query("merged_terms", """SELECT power, sum(coef) AS coef FROM (SELECT p_size AS power, CAST(count(*) AS BIGINT) AS coef FROM part GROUP BY 1
  UNION ALL SELECT l_linenumber, count(*) FROM lineitem GROUP BY 1) GROUP BY power""".replace("sum(coef)", "CAST(sum(coef) AS BIGINT)"))
def merged_terms(spark, d):
    a = table(spark, d, "part").groupBy(F.col("p_size").alias("power")).agg(F.count(F.lit(1)).alias("coef"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("power")).agg(F.count(F.lit(1)).alias("coef"))
    return rec.merge_terms(a, b, "power", "coef")


@query("multiset_difference", """SELECT nation, CAST(sum(a) AS BIGINT) AS n_left, CAST(sum(b) AS BIGINT) AS n_right FROM (
  SELECT c_nationkey AS nation, 1 AS a, 0 AS b FROM customer UNION ALL SELECT s_nationkey, 0, 1 FROM supplier) GROUP BY nation HAVING sum(a) <> sum(b)""")
def multiset_difference(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return rec.multiset_difference(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"])


@query("distinct_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return rec.distinct_union(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 10")
def set_difference(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity > 10").select(F.col("l_partkey").alias("p_partkey"))
    return rec.set_difference(table(spark, d, "part").select("p_partkey"), used)


@query("filled_records", """SELECT doc_id, lang, coalesce(n, '') AS note, CASE WHEN n IS NULL THEN [] ELSE [n] END AS notes FROM (
  SELECT d.doc_id, lang, CASE l.quality WHEN 1 THEN 'good' END AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def filled_records(spark, d):
    note = F.when(F.col("quality") == 1, "good")
    notes = table(spark, d, "labels").select("doc_id", note.alias("note"), F.when(note.isNotNull(), F.array(note)).alias("notes"))
    df = table(spark, d, "documents").select("doc_id", "lang").join(notes, "doc_id", "left")
    return df.select(*[rec.fill_nulls(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


@query("unknown_keys", "SELECT event_id, list_filter(json_keys(props), lambda k: k <> 'a') AS extra FROM events")
def unknown_keys(spark, d):
    return table(spark, d, "events").select("event_id", rec.unknown_keys(F.col("props"), ["a"]).alias("extra"))


@query("catalog_union", """SELECT name, kind, count(*) AS n FROM (SELECT p_name AS name, p_type AS kind FROM part UNION ALL
  SELECT unnest([n_name, r_name]), 'place' FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL
  SELECT unnest([s_name, n_name]), 'source' FROM supplier JOIN nation ON n_nationkey = s_nationkey) GROUP BY ALL""")
def catalog_union(spark, d):
    """Catalog rows with three nested collections, flattened with duplicates kept."""
    def entry(name, kind):
        return F.struct(F.col(name).alias("name"), kind.alias("kind"))

    empty = "array<struct<name:string,kind:string>>"
    nation = table(spark, d, "nation")
    parts = table(spark, d, "part").select(F.array(entry("p_name", F.col("p_type"))).alias("all_functions"))
    places = nation.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.array(entry("n_name", F.lit("place")), entry("r_name", F.lit("place"))).alias("functions"))
    sources = table(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.create_map(F.lit("main.c"), F.array(entry("s_name", F.lit("source")), entry("n_name", F.lit("source")))).alias("source_files"))
    full = parts.unionByName(places, allowMissingColumns=True).unionByName(sources, allowMissingColumns=True)
    full = full.withColumn("functions", F.coalesce("functions", F.array().cast(empty)))
    return rec.catalog_entries(full).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("file_rollup", """SELECT file, CAST(sum(n) AS BIGINT) AS functions, count(*) AS files FROM (
  SELECT p_brand AS file, count(*) AS n FROM part GROUP BY 1) GROUP BY ROLLUP (file)""")
def file_rollup(spark, d):
    return rec.file_rollup(table(spark, d, "part").select(F.col("p_brand").alias("file")), "file")


@query("path_counts", """SELECT count(*) AS functions, CAST(sum(n) AS BIGINT) AS paths FROM (
  SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def path_counts(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("functions"), F.sum("n").alias("paths"))


@query("regrouped_turns", """SELECT conv_id, flatten(list([role, text] ORDER BY turn)) AS items,
  first(role ORDER BY turn) AS role FROM conversations GROUP BY conv_id""")
def regrouped_turns(spark, d):
    df = table(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.array("role", "text").alias("items"))
    return rec.regroup(df, "conv_id", "items", ["role"], "turn")


# -- words and text
WORDS_SQL = """w AS (SELECT lower(regexp_replace(x, '-$', '')) AS word FROM (
  SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?:[''-][A-Za-z]+)*[''-]?')) AS x FROM documents)),
counts AS (SELECT word, count(*) AS n FROM w GROUP BY word)"""


@query("word_counts", f"WITH {WORDS_SQL} SELECT word, n FROM counts")
def word_counts(spark, d):
    return tx.word_counts(table(spark, d, "documents"), "text")


@query("word_report", f"""WITH {WORDS_SQL} SELECT 'No. ' || row_number() OVER (ORDER BY word) || ': ' || word || ' ' || n AS line FROM counts""")
def word_report(spark, d):
    """Numbered, alphabetical frequency table."""
    ranked = global_rank(tx.word_counts(table(spark, d, "documents"), "text"), "word", name="no")
    return ranked.select(F.format_string("No. %d: %s %d", "no", "word", "n").alias("line"))


@query("rank_weighted_score", f"""WITH {WORDS_SQL}, r AS (SELECT word, row_number() OVER (ORDER BY word) AS k FROM counts)
  SELECT CAST(sum(k * list_sum(list_transform(string_split(regexp_replace(upper(word), '[^A-Z]', '', 'g'), ''),
    lambda c: CASE WHEN c = '' THEN 0 ELSE ascii(c) - 64 END))) AS BIGINT) AS score FROM r""")
def rank_weighted_score(spark, d):
    ranked = global_rank(tx.word_counts(table(spark, d, "documents"), "text").select("word"), "word", name="k")
    return ranked.agg(F.sum(F.col("k") * tx.letter_score(F.col("word"))).cast("long").alias("score"))


@query("letter_scores", """SELECT p_partkey, CAST(list_sum(list_transform(string_split(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), ''),
    lambda c: CASE WHEN c = '' THEN 0 ELSE ascii(c) - 64 END)) AS BIGINT) AS score FROM part""")
def letter_scores(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.letter_score(F.col("p_name")).alias("score"))


@query("prefix_words", f"WITH {WORDS_SQL} SELECT word, n FROM counts WHERE starts_with(word, 'the')")
def prefix_words(spark, d):
    return tx.word_counts(table(spark, d, "documents"), "text").filter(F.col("word").startswith("the"))


@query("partial_words", f"WITH {WORDS_SQL} SELECT word, n FROM counts WHERE regexp_matches(word, '^t.e.$')")
def partial_words(spark, d):
    counts = tx.word_counts(table(spark, d, "documents"), "text")
    return counts.filter(tx.partial_match(F.col("word"), "t.e."))


@query("near_words", f"""WITH {WORDS_SQL} SELECT word, n FROM counts WHERE list_sum(list_transform(range(1, greatest(length(word), 5) + 1),
  lambda i: CASE WHEN substr(word, i, 1) <> substr('there', i, 1) THEN 1 ELSE 0 END)) <= 2""")
def near_words(spark, d):
    counts = tx.word_counts(table(spark, d, "documents"), "text")
    return counts.filter(tx.near_match(F.col("word"), "there", 2))


@query("quoted_names", """SELECT page_id, CAST(unnest(range(len(q))) AS INTEGER) AS pos, unnest(q) AS name FROM (
  SELECT page_id, regexp_extract_all(html, '"([^"]*)"', 1) AS q FROM pages)""")
def quoted_names(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(tx.quoted_names(F.col("html"))).alias("pos", "name"))


@query("fenced_text", """SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(f, E' \\t\\r\\n'), '^```(json)?', ''), '```$', ''),
  E' \\t\\r\\n') AS body FROM (SELECT conv_id, turn, '```json' || chr(10) || text || chr(10) || '```' AS f FROM conversations)""")
def fenced_text(spark, d):
    df = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("```json\n"), "text", F.lit("\n```")).alias("f"))
    return df.select("conv_id", "turn", tx.strip_fence(F.col("f")).alias("body"))


@query("extracted_json", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS found FROM events")
def extracted_json(spark, d):
    """Plain text around braces, a fenced JSON block after other braces, any fenced block, and text without JSON."""
    kind = F.col("event_id") % 4
    noisy = (
        F.when(kind == 0, F.concat(F.lit("Result: "), F.col("props"), F.lit(" done")))
        .when(kind == 1, F.concat(F.lit("use {x} then\n```json\n"), F.col("props"), F.lit("\n```\n")))
        .when(kind == 2, F.concat(F.lit("{a} or\n```\n"), F.col("props"), F.lit("\n```")))
        .otherwise(F.concat(F.lit("{"), F.col("event_type"), F.lit("} none")))
    )
    return table(spark, d, "events").select("event_id", tx.outer_braces(noisy).alias("found"))


_ALPHABET = "".join(chr(32 + i) for i in range(95))
_AFFINE = "".join(chr(32 + (7 * i + 20) % 95) for i in range(95))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("affine_cipher", f"SELECT doc_id, translate(text, {_quoted(_ALPHABET)}, {_quoted(_AFFINE)}) AS cipher FROM documents")
def affine_cipher(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.affine_encrypt(F.col("text"), 7, 20).alias("cipher"))


@query("affine_round_trip", "SELECT doc_id, text FROM documents")
def affine_round_trip(spark, d):
    cipher = tx.affine_encrypt(F.col("text"), 7, 20)
    return table(spark, d, "documents").select("doc_id", tx.affine_decrypt(cipher, 7, 20).alias("text"))


@query("lcs_names", """WITH RECURSIVE pairs AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part),
  r AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS cells FROM pairs UNION ALL
    SELECT a, b, i + 1, list_transform(range(length(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k:
      greatest(cells[k + 1], CASE WHEN k > 0 AND substr(b, k, 1) = substr(a, i + 1, 1) THEN cells[k] + 1 ELSE 0 END))))
    FROM r WHERE i < length(a))
  SELECT p_partkey, CAST(cells[-1] AS INTEGER) AS lcs FROM part JOIN r ON a = p_name AND b = lower(p_type) AND i = length(a)""")
def lcs_names(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.lcs_length(F.col("p_name"), F.lower("p_type")).alias("lcs"))


@query("lcs_texts")
def lcs_texts(spark, d):
    """The subsequences themselves; tests compare with a plain table walk."""
    # A small file is one partition, but its rows cost much more than reading them.
    names = table(spark, d, "part").select("p_partkey", "p_name", "p_type").repartition(4 * spark.sparkContext.defaultParallelism)
    return names.select("p_partkey", tx.lcs_text(F.col("p_name"), F.lower("p_type")).alias("lcs"))


# -- sorts and ranks
@query("sorted_ranks", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def sorted_ranks(spark, d):
    return global_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", name="place").select("o_orderkey", "place")


@query("sorted_strings", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_name) AS place FROM customer")
def sorted_strings(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return global_rank(df, "c_mktsegment", "c_name", name="place").select("c_custkey", "place")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("second_smallest", """SELECT o_totalprice AS value FROM (SELECT DISTINCT o_totalprice FROM orders ORDER BY 1 LIMIT 2)
  ORDER BY 1 DESC LIMIT 1""")
def second_smallest(spark, d):
    two = table(spark, d, "orders").select(F.col("o_totalprice").alias("value")).distinct().orderBy("value").limit(2)
    return two.orderBy(F.desc("value")).limit(1)


@query("pairwise_turns", """SELECT conv_id, turn, role, next_role FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
  FROM conversations) WHERE next_role IS NOT NULL""")
def pairwise_turns(spark, d):
    """Adjacent pairs: each turn with the next one there is."""
    talk = table(spark, d, "conversations").select("conv_id", "turn", "role")
    s = Series.of(talk, ["conv_id"], ["turn"], 1000).span(1)
    s = s.add(first_turn=s.lag("turn"), first_role=s.lag("role")).owned()
    return s.df.filter("rn > 1").select("conv_id", F.col("first_turn").alias("turn"), F.col("first_role").alias("role"), F.col("role").alias("next_role"))


# -- calls to a service
def _unsteady(text, attempt):
    """Stands for a service, and fails by the length of the text: late, in part, always, or not at all."""
    kind = len(text or "") % 4
    if kind == 0 and attempt < 2 or kind == 2:
        raise TimeoutError("no answer")
    return '```json\n{"length": %d}\n```' % len(text or "") if kind != 1 else '{"attempt": %d}' % attempt


@query("calls_with_recovery", """SELECT conv_id, turn, CASE length(coalesce(text, '')) % 4 WHEN 2 THEN NULL WHEN 1 THEN '{"attempt": 2}'
    ELSE '{"length": ' || length(coalesce(text, '')) || '}' END AS answer,
  CASE length(coalesce(text, '')) % 4 WHEN 2 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'ok' END AS answer_state,
  CASE length(coalesce(text, '')) % 4 WHEN 3 THEN 1 ELSE 3 END::BIGINT AS answer_calls FROM conversations""")
def calls_with_recovery(spark, d):
    """A JSON answer per turn from a service that fails now and then; the last JSON stands if none is complete."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return calls.call_json(turns, "text", _unsteady, lambda x: "length" in x, "answer", first_wait=0.0).drop("text")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
