"""Queries that show each operator on the driver's tables, with their SQL counterparts.

Each is registered once, with its SQL, by ``query``.  Results are flat columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalar as sc
from tessella.functions import sequence as sq
from tessella.operators import diagnostics as diag
from tessella.operators import invocation, profiles, terminology, validation
from tessella.operators.resource import Extension, Resource, bundle, entry, updated
from tessella.sources import documents, hl7v2

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _uuid_sql(x: str) -> str:
    h = f"sha1({x})"
    return (
        f"concat(substr({h},1,8),'-',substr({h},9,4),'-5',substr({h},14,3),'-',"
        f"substr('89ab', (strpos('0123456789abcdef', substr({h},17,1))-1) % 4 + 1, 1),substr({h},18,3),'-',substr({h},21,12))"
    )


def _patient(customer: DataFrame) -> Column:
    pid = sc.seeded_uuid(sc.text(customer["c_custkey"]))
    r = Resource(profiles.PATIENT, pid)
    r.assign("identifier", F.struct(pid.alias("value")))
    r.assign("active", sc.equal(customer["c_mktsegment"], "BUILDING"))
    name = Resource(profiles.HUMAN_NAME).assign("given", sq.item(sc.split_text(customer["c_name"], "#"), 0)).assign("family", customer["c_name"])
    r.assign("name", name.column())
    return r.column()


@query(
    f"""select c_custkey, 'Patient' as resource_type, {_uuid_sql("cast(c_custkey as varchar)")} as id,
    c_mktsegment = 'BUILDING' as active, c_name as family, split_part(c_name, '#', 1) as given from customer"""
)
def patient_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    p = c.select("c_custkey", _patient(c).alias("p"))
    name = sq.item(F.col("p.name"), 0)
    return p.select(
        "c_custkey", F.col("p.resourceType").alias("resource_type"), "p.id", "p.active", name["family"].alias("family"), sq.item(name["given"], 0).alias("given")
    )


@query(
    """select s_suppkey, 'Practitioner' as resource_type, cast(s_suppkey as varchar) as id, s_name as family, 1 as n_names,
    s_acctbal > 0 as active from supplier"""
)
def practitioner_from_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    r = Resource(profiles.PRACTITIONER, s["s_suppkey"]).assign("active", s["s_acctbal"] > 0)
    r.assign("name", Resource(profiles.HUMAN_NAME).assign("family", s["s_name"]).column())
    p = s.select("s_suppkey", r.column().alias("p"))
    return p.select(
        "s_suppkey", F.col("p.resourceType").alias("resource_type"), "p.id", sq.item(F.col("p.name"), 0)["family"].alias("family"),
        F.size("p.name").alias("n_names"), "p.active",
    )


@query(f"""select o_orderkey, {_uuid_sql("concat('Order', cast(o_orderkey as varchar))")} as id from orders""")
def uuid_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", sc.seeded_uuid(sc.join_present("Order", sc.text(F.col("o_orderkey")))).alias("id"))


@query(
    f"""select n_nationkey, concat('urn:uuid:', {_uuid_sql("concat('{\"resourceType\":\"Organization\",\"id\":\"', n_nationkey, '\",\"name\":\"', n_name, '\"}')")}) as full_url
    from nation"""
)
def content_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    r = Resource(profiles.ORGANIZATION, n["n_nationkey"]).assign("name", n["n_name"])
    return n.select("n_nationkey", sc.content_link(r.column()).alias("full_url"))


@query(
    """select case when n_nationkey % 3 = 0 then '' else cast(n_nationkey as varchar) end as nationkey,
    concat(n_name, ', "', n_regionkey, '"', chr(10), '!') as name, case when n_regionkey > 0 then cast(n_regionkey as varchar) end as regionkey from nation"""
)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty first cells, quotes, commas and line ends inside them, and rows that are short."""
    n = _t(spark, sf_dir, "nation")
    key = F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_nationkey").cast("string"))
    name = F.concat(F.lit('"'), F.col("n_name"), F.lit(', ""'), F.col("n_regionkey"), F.lit('""\n!"'))
    short = F.when(F.col("n_regionkey") > 0, F.concat(F.lit(","), F.col("n_regionkey"))).otherwise("")
    text = F.concat(F.lit(" key , name , region\r\n"), key, F.lit(","), name, short)
    row = F.get(documents.csv_objects(text), F.lit(0))
    rows = n.select(row.alias("r"))
    return rows.select(*[F.try_element_at("r", F.lit(k)).alias(v) for k, v in (("key", "nationkey"), ("name", "name"), ("region", "regionkey"))])


def _pid(customer: DataFrame) -> Column:
    """Messages whose version, birth date's precision and address depend on the row."""
    seg = lambda *p: F.concat_ws("|", *p)
    key, none = F.col("c_custkey").cast("string"), F.lit("")
    birth = F.when(F.col("c_custkey") % 3 == 0, "1984").otherwise(F.concat(F.lit("19840"), F.col("c_custkey") % 9 + 1, F.lit("17")))
    city = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("9 Mill Lane^^"), F.col("c_mktsegment"))).otherwise("")
    msh = F.concat(F.lit("MSH|^~\\&|Ward^3|North|||201706150"), F.col("c_custkey") % 9 + 1, F.lit("30||ADT^A08|"), key, F.lit("|T|2.5.1"))
    pid = seg(F.lit("PID"), F.lit("1"), none, F.concat(key, F.lit("^^^^PI")), none, F.concat(F.col("c_name"), F.lit("^"), F.col("c_mktsegment")), none, birth, F.lit("X"), none, none, city)
    return F.concat(msh, F.lit("\n"), pid)


@query(
    """select c_custkey, cast(c_custkey as varchar) as id_number, 'PI' as id_type, c_name as surname, c_mktsegment as given,
    case when c_custkey % 3 = 0 then '1984' else concat('1984-0', c_custkey % 9 + 1, '-17') end as birth,
    concat('2017-06-15T0', c_custkey % 9 + 1, ':30') as sent, 2 as line, case when c_acctbal >= 0 then c_mktsegment end as city from customer"""
)
def hl7_pid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    m = c.select("c_custkey", _pid(c).alias("m"))
    parsed = m.select(
        "c_custkey", F.get(hl7v2.segment(F.col("m"), "PID"), F.lit(0)).alias("p"), F.get(hl7v2.segment(F.col("m"), "MSH"), F.lit(0)).alias("h")
    )
    return parsed.select(
        "c_custkey", F.col("p.PatientIdentifierList.IDNumber").alias("id_number"), F.col("p.PatientIdentifierList.IdentifierTypeCode").alias("id_type"),
        F.col("p.PatientName.FamilyName.Surname").alias("surname"), F.col("p.PatientName.GivenName").alias("given"),
        F.col("p.DateTimeOfBirth.Time").alias("birth"), F.col("h.DateTimeOfMessage.Time").alias("sent"), F.col("p.MessageLine").alias("line"),
        F.col("p.PatientAddress.City").alias("city"),
    )


@query(
    """select c_custkey, case when c_custkey % 2 = 0 then '2016-02-03T04:05' end as new_time, case when c_custkey % 2 = 1 then '201602030405' end as old_time,
    c_mktsegment as raw, case when c_acctbal < 0 then '2' end as second from customer"""
)
def hl7_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of each message's own version; segments that no dictionary has are kept raw."""
    version = F.when(F.col("c_custkey") % 2 == 0, "2.5.1").otherwise("2.3")
    again = F.when(F.col("c_acctbal") < 0, "\rZBX|2").otherwise("")
    text = F.concat(F.lit("MSH|^~\\&|a||||201602030405||ADT^A01|1|P|"), version, F.lit("\rZBX|1||"), F.col("c_mktsegment"), again)
    j = _t(spark, sf_dir, "customer").select("c_custkey", hl7v2.to_json(text).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    return j.select(
        "c_custkey", at("$.MSH.DateTimeOfMessage.Time").alias("new_time"), at("$.MSH.DateTimeOfMessage.TimeOfAnEvent").alias("old_time"),
        F.coalesce(at("$.ZBX.ZBX3"), at("$.ZBX[0].ZBX3")).alias("raw"), at("$.ZBX[1].ZBX1").alias("second"),
    )


@query(
    """select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) + 1 as line,
    cast(l_linenumber as varchar) as set_id, cast(cast(l_quantity as bigint) as varchar) as value from lineitem"""
)
def hl7_repeat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    groups = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(key)).alias("k"))
    obx = F.transform("k", lambda k: F.concat(F.lit("OBX|"), k["l_linenumber"], F.lit("|NM|Q||"), k["l_quantity"].cast("bigint")))
    text = F.concat(F.lit("MSH|^~\\&|||||||ORU^R01||P|2.5.1\n"), F.array_join(obx, "\n"))
    rows = groups.select("l_orderkey", F.explode(hl7v2.segment(text, "OBX")).alias("s"))
    return rows.select(
        "l_orderkey", F.col("s.MessageLine").cast("bigint").alias("line"), F.col("s.SetID").alias("set_id"), F.col("s.ObservationValue").alias("value")
    )


@query("select n_nationkey, n_name as given, concat('R', n_regionkey) as family from nation")
def xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    text = F.concat(F.lit("<root><given>"), F.col("n_name"), F.lit('</given><family value="R'), F.col("n_regionkey"), F.lit('"/></root>'))
    x = documents.xml_document(text, "given string, family struct<_value:string>")
    rows = n.select("n_nationkey", x.alias("x"))
    return rows.select("n_nationkey", documents.xml_value(F.col("x.given")).alias("given"), documents.xml_value(F.col("x.family"), nested=True).alias("family"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as missing from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    d = e.select("event_id", documents.json_document(F.col("props")).alias("d"))
    return d.select("event_id", documents.json_value(F.col("d"), "$.k", "bigint").alias("k"), documents.json_value(F.col("d"), "$.none").alias("missing"))


_STATUS = {"F": "completed", "O": "active"}


@query(
    """select o_orderkey, t.target as status, case o_orderstatus when 'F' then 'completed' when 'O' then 'active' end as folded
    from orders left join (values ('F','completed'),('O','active')) t(code, target) on o_orderstatus = t.code"""
)
def translate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    cm = spark.createDataFrame(list(_STATUS.items()), "code string, target_code string")
    rows = terminology.translate(o, "o_orderstatus", cm, "status")
    return rows.select("o_orderkey", "status", terminology.translate_literal(F.col("o_orderstatus"), _STATUS).alias("folded"))


_SEGMENTS = ["BUILDING", "AUTOMOBILE", "MACHINERY"]


@query(
    """select c_custkey, not bad as ok, case when bad then 206 else 200 end as status, case when bad then 'F5120' end as code,
    case when bad then concat('Value "', c_mktsegment, '" for "segment" in "Customer" is not in the required ValueSet.') end as message
    from (select c_custkey, c_mktsegment, c_mktsegment not in ('BUILDING','AUTOMOBILE','MACHINERY') as bad from customer)"""
)
def binding_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    found = diag.gathered(validation.required_code(F.col("c_mktsegment"), _SEGMENTS, "segment", "Customer"))
    r = c.select("c_custkey", diag.report(F.struct("c_name"), found).alias("r"))
    return r.select("c_custkey", "r.ok", "r.status", diag.primary_code(F.col("r")).alias("code"), diag.primary(F.col("r"))["message"].alias("message"))


@query(
    """select o_orderkey, list_has_any([o_orderstatus, substr(o_orderpriority, 1, 1)], ['F', '1']) as ok,
    case when not list_has_any([o_orderstatus, substr(o_orderpriority, 1, 1)], ['F', '1']) then 'F5123' end as code from orders"""
)
def codeableconcept_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    coding = lambda c: F.struct(F.lit("urn:s").alias("system"), c.alias("code"))
    codings = F.array(coding(F.col("o_orderstatus")), coding(F.substring("o_orderpriority", 1, 1)))
    rows = o.select("o_orderkey", codings.alias("c"))
    ok = terminology.any_coding_in(F.col("c"), [("urn:s", "F"), ("urn:s", "1")])
    return rows.select("o_orderkey", ok.alias("ok"), validation.required_concept(F.col("c"), ok, "code", "Order")["code"].alias("code"))


@query(
    """select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then 'own' end, t.d) as display
    from orders left join (values ('F','Filled'),('O','Open')) t(c, d) on o_orderstatus = t.c"""
)
def display_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").withColumns({"system": F.lit("urn:s"), "display": F.when(F.col("o_orderkey") % 3 == 0, "own")})
    known = spark.createDataFrame([("urn:s", "F", "Filled"), ("urn:s", "O", "Open")], "system string, code string, display string")
    return terminology.with_display(o, "system", "o_orderstatus", "display", known).select("o_orderkey", "display")


@query(
    """select o_orderkey, case when o_orderstatus = 'P' then
    'The FHIR element "status" is mandatory in "Order" (minimum 1), but no value was provided.' end as message, o_orderstatus <> 'P' as ok from orders"""
)
def cardinality_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    check = validation.mandatory(status, "status", "Order")
    r = _t(spark, sf_dir, "orders").select("o_orderkey", diag.report(status, diag.gathered(check)).alias("r"))
    return r.select("o_orderkey", diag.primary(F.col("r"))["message"].alias("message"), "r.ok")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y') as year from orders")
def coerce_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select("o_orderkey", validation.to_date(stamp).alias("day"), validation.to_date(F.date_format("o_orderdate", "yyyy")).alias("year"))


@query(
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag = 'N' then l_extendedprice end as price from lineitem"""
)
def coerce_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as text keep all of their digits; other text gives nothing."""
    text = F.when(F.col("l_returnflag") == "N", F.concat(F.lit(" "), F.col("l_extendedprice").cast("string"))).otherwise(F.concat("l_extendedprice", F.lit("d")))
    line = _t(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", validation.to_decimal(text).alias("price"))


@query("select o_orderkey, coalesce(case when o_orderstatus <> 'P' then o_orderstatus end, o_orderpriority) as kept, o_orderpriority as single from orders")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    values = F.array("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return o.select("o_orderkey", sq.last(values).alias("kept"), validation.single(F.array("o_orderpriority")).alias("single"))


@query(
    """select l_orderkey, count(*) as n, cast(sum(l_linenumber) as bigint) as numbers, count(*) filter (l_returnflag = 'R') as returned
    from lineitem group by l_orderkey"""
)
def context_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem")
    orders = line.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("lines"))
    r = Resource(profiles.OBSERVATION).assign("status", F.lit("final")).assign("code", F.struct(F.lit("order").alias("text")))
    body = lambda x: F.struct(x["l_linenumber"].alias("number"), sc.choose(x["l_returnflag"] == "R", F.lit("returned")).alias("note"))
    made = orders.select("l_orderkey", r.context("component", F.col("lines"), body).column().alias("r"))
    parts = F.col("r.component")
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p["number"])
    return made.select("l_orderkey", F.size(parts).cast("bigint").alias("n"), total.alias("numbers"), F.size(sq.walk(parts, "note")).cast("bigint").alias("returned"))


@query(
    """select c_custkey, case when c_acctbal > 0 then 'http://hl7.org/fhir/sid/us-ssn' else 'http://example.com/identifier/mrn' end as system,
    case when c_acctbal > 0 then c_name else cast(c_custkey as varchar) end as value, case when c_acctbal > 0 then 2 else 1 end as n from customer"""
)
def slice_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice without a value is left out, its fixed content with it."""
    c = _t(spark, sf_dir, "customer")
    r = Resource(profiles.PATIENT).slice("identifier", "ssn", value=F.when(c["c_acctbal"] > 0, c["c_name"])).slice("identifier", "mrn", value=sc.text(c["c_custkey"]))
    p = c.select("c_custkey", r.column().alias("p"))
    first = sq.item(F.col("p.identifier"), 0)
    return p.select("c_custkey", first["system"].alias("system"), first["value"].alias("value"), F.size("p.identifier").alias("n"))


@query(
    """select c_custkey, case when c_acctbal > 0 then 1 else 0 end as n, case when c_acctbal > 0 then 'urn:example:segment' end as url,
    case when c_acctbal > 0 then c_mktsegment end as code from customer"""
)
def extension_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension by its definition; none for a missing value."""
    c = _t(spark, sf_dir, "customer")
    segment = Extension("urn:example:segment", "valueCode")
    p = c.select("c_custkey", Resource(profiles.PATIENT).extension(segment, F.when(c["c_acctbal"] > 0, c["c_mktsegment"])).column().alias("p"))
    first = sq.item(F.col("p.extension"), 0)
    return p.select("c_custkey", F.greatest(F.coalesce(F.size("p.extension"), F.lit(0)), F.lit(0)).alias("n"), first["url"].alias("url"), first["valueCode"].alias("code"))


@query("select c_custkey, case when c_acctbal >= 0 then 1 else 0 end as n, case when c_acctbal >= 0 then c_name end as value from customer")
def empty_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    given = sq.listed(F.when(F.col("c_acctbal") >= 0, F.col("c_name")))
    r = Resource(profiles.PATIENT).context("identifier", given, lambda v: F.struct(F.lit("urn:x").alias("system"), v.alias("value")))
    p = c.select("c_custkey", r.column().alias("p"))
    return p.select("c_custkey", F.coalesce(F.size("p.identifier"), F.lit(0)).alias("n"), sq.item(F.col("p.identifier"), 0)["value"].alias("value")).withColumn(
        "n", F.greatest("n", F.lit(0))
    )


@query(
    """select event_id, case when event_type = 'click' then 'c' end as only_then, case when event_type = 'view' then 'v' when event_type = 'click' then 'c' end as chain,
    case when event_type = 'error' then null else event_type end as kept from events"""
)
def conditional_no_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kind = F.col("event_type")
    maybe = F.when(kind != "error", kind)
    chain = sc.choose(sc.equal(kind, "view"), F.lit("v"), sc.choose(sc.equal(kind, "click"), F.lit("c")))
    return e.select("event_id", sc.choose(sc.equal(kind, "click"), F.lit("c")).alias("only_then"), chain.alias("chain"), sc.choose(sc.present(maybe), maybe).alias("kept"))


@query("select c_custkey, concat('seg/', case when c_acctbal > 0 then c_mktsegment end, '/', c_name) as text from customer")
def concat_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", sc.join_present("seg/", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), "/", F.col("c_name")).alias("text"))


@query("select p_partkey, split_part(p_brand, '#', 1) as zero, nullif(split_part(p_brand, '#', 2), '') as one, len(string_split(p_brand, '#')) as n from part")
def split_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", sc.split_text(F.col("p_brand"), "#").alias("parts"))
    keyed = p.select("p_partkey", "parts", sq.keyed(F.col("parts"), lambda v, i: i.cast("string")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return keyed.select("p_partkey", at("0").alias("zero"), F.nullif(at("1"), F.lit("")).alias("one"), F.size("parts").cast("bigint").alias("n"))


@query(
    "select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: len(w) % 2 = 0), ' ') as even,"
    " array_to_string(list_filter(string_split(p_name, ' '), lambda w: len(w) % 2 = 1), ' ') as odd from part"
)
def split_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a sequence grouped by a computed key that repeats."""
    p = _t(spark, sf_dir, "part").select("p_partkey", sc.split_text(F.col("p_name"), " ").alias("parts"))
    rows = p.select("p_partkey", sq.grouped(F.col("parts"), lambda v, i: F.when(F.length(v) % 2 == 0, "even").otherwise("odd")).alias("m"))
    at = lambda k: F.array_join(F.coalesce(F.try_element_at("m", F.lit(k)), F.array().cast("array<string>")), " ").alias(k)
    return rows.select("p_partkey", at("even"), at("odd"))


@query("select n_nationkey, concat(n_nationkey, ' ', n_name) as joined, n_name as clean from nation")
def join_trim_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    padded = F.concat(F.lit("  "), F.col("n_name"), F.lit(" \t"))
    both = F.array(sc.text(F.col("n_nationkey").cast("double")), F.lit(None).cast("string"), F.col("n_name"))
    return n.select("n_nationkey", sc.join_list(both, " ").alias("joined"), sc.trimmed(padded).alias("clean"))


@query("select c_custkey, concat('urn:ssn:', c_custkey) as value from customer")
def alias_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.engine import Engine

    engine = Engine()
    engine.aliases = {"ssn": "urn:overridden:"}
    rows = engine.transform(
        _t(spark, sf_dir, "customer"), lambda d, b: sc.join_present(b["ssn"], sc.text(d["c_custkey"])), "value", ssn="urn:ssn:"
    )
    return rows.select("c_custkey", "value")


@query("select c_custkey, concat('a', c_name, 'b') as value from customer")
def mapping_as_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.engine import Engine

    engine = Engine()
    engine.register_mapping("wrap", lambda value, b: sc.join_present(b["left"], value, b["right"]))
    mapping = lambda d, b: b["wrap"](d["c_name"], {"left": "a", "right": "b"})
    return engine.transform(_t(spark, sf_dir, "customer"), mapping, "value").select("c_custkey", "value")


@query(
    """select event_id, case event_type when 'error' then false else true end as ok, case event_type when 'error' then 206 else 200 end as status,
    case event_type when 'error' then 1 else 0 end as errors, case event_type when 'purchase' then 1 else 0 end as warnings,
    case event_type when 'error' then 'error' when 'purchase' then 'warning' end as level from events"""
)
def severity_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kind = F.col("event_type")
    found = diag.gathered(F.when(kind == "error", diag.diagnostic("F5000", kind, 20)), F.when(kind == "purchase", diag.warn(kind)))
    r = e.select("event_id", diag.normalized(diag.report(kind, found)).alias("r"))
    d = F.col("r.diagnostics")
    return r.select(
        "event_id", "r.ok", "r.status", F.size(d["error"]).alias("errors"), F.size(d["warning"]).alias("warnings"), diag.primary(F.col("r"))["level"].alias("level")
    )


@query("select o_orderkey, case when c_custkey is not null then concat('Patient/', c_custkey) end as reference from orders left join customer on o_custkey = c_custkey")
def literal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("id"))
    return terminology.lookup_reference(_t(spark, sf_dir, "orders"), "o_custkey", patients, "c_custkey", "Patient", "reference").select("o_orderkey", "reference")


@query(
    """select o_custkey, count(*) as n, 'transaction' as type, min(o_orderkey) as first_key,
    concat('PUT ', min(o_orderkey)) as request from orders group by o_custkey"""
)
def bundle_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bundle for each customer; a customer's orders are few by nature."""
    o = _t(spark, sf_dir, "orders")
    resource = F.struct(F.lit("ServiceRequest").alias("resourceType"), F.col("o_orderkey").alias("id"))
    e = entry(resource, F.lit("PUT"), F.col("o_orderkey").cast("string"))
    groups = o.groupBy("o_custkey").agg(F.collect_list(e).alias("e"))
    in_order = F.array_sort("e", lambda a, b: F.when(a["resource"]["id"] < b["resource"]["id"], -1).when(a["resource"]["id"] > b["resource"]["id"], 1).otherwise(0))
    b = groups.select("o_custkey", bundle(in_order).alias("b"))
    first = sq.item(F.col("b.entry"), 0)
    return b.select(
        "o_custkey", F.size("b.entry").cast("bigint").alias("n"), "b.type", first["resource"]["id"].alias("first_key"),
        F.concat_ws(" ", first["request"]["method"], first["request"]["url"]).alias("request"),
    )


@query(
    """select c_custkey, concat('c', c_custkey) as id, case when c_acctbal > 0 then c_name end as name, c_mktsegment = 'BUILDING' as extra from customer"""
)
def update_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    base = F.struct(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"))
    changed = updated(base, ["id", "name"], id=F.concat(F.lit("c"), "c_custkey"), extra=sc.equal(F.col("c_mktsegment"), "BUILDING"))
    return c.select("c_custkey", changed.alias("u")).select("c_custkey", "u.id", "u.name", "u.extra")


@query(
    """select h as name, case when lower(h) in ('authorization','proxy-authorization','cookie','set-cookie') or lower(h) like '%token%'
    or lower(h) like '%secret%' or lower(h) like '%password%' or lower(h) like '%session%' or lower(h) like '%api-key%' or lower(h) like '%apikey%'
    then '[REDACTED]' else 'v' end as value
    from (values ('Authorization'),('Cookie'),('X-Api-Key'),('X-ApiKey'),('X-Auth-Token'),('Accept'),('Session-Id'),('Host')) t(h)"""
)
def invocation_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Authorization", "Cookie", "X-Api-Key", "X-ApiKey", "X-Auth-Token", "Accept", "Session-Id", "Host"]
    headers = F.create_map(*[F.lit(x) for n in names for x in (n, "v")])
    return spark.range(1).select(F.explode(invocation.redacted(headers)).alias("name", "value"))


@query(
    """select o_orderkey, round(o_totalprice, 2) as systolic, 'mm[Hg]' as unit, 'http://hl7.org/fhir/StructureDefinition/bp' as profile,
    '8480-6' as code, '85354-9' as root, 'vital-signs' as category, case when o_orderstatus = 'F' then 2 else 1 end as n,
    case when o_orderstatus = 'F' then '8462-4' end as other, concat('c', o_custkey) as subject from orders"""
)
def profile_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the profile fixes at its root and in its slices comes with it."""
    o = _t(spark, sf_dir, "orders")
    r = Resource(profiles.BLOOD_PRESSURE).assign("status", F.lit("final")).assign("subject.identifier.value", F.concat(F.lit("c"), "o_custkey"))
    low = F.when(F.col("o_orderstatus") == "F", F.round("o_totalprice", 2))
    r.slice("component", "SystolicBP", value=F.round("o_totalprice", 2)).slice("component", "DiastolicBP", value=low)
    p = o.select("o_orderkey", r.column().alias("p"))
    part = lambda i: sq.item(F.col("p.component"), i)
    code = lambda c: sq.item(c["coding"], 0)["code"]
    return p.select(
        "o_orderkey", part(0)["valueQuantity"]["value"].alias("systolic"), part(0)["valueQuantity"]["code"].alias("unit"),
        sq.item(F.col("p.meta.profile"), 0).alias("profile"), code(part(0)["code"]).alias("code"), code(F.col("p.code")).alias("root"),
        code(sq.item(F.col("p.category"), 0)).alias("category"), F.size("p.component").alias("n"), code(part(1)["code"]).alias("other"),
        F.col("p.subject.identifier.value").alias("subject"),
    )


@query("select s_suppkey, case when s_acctbal > 0 then s_name end as value, true as only_last from supplier")
def choice_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two types of one choice are set; the last one stays."""
    s = _t(spark, sf_dir, "supplier")
    r = Resource(profiles.OBSERVATION).assign("status", F.lit("final")).assign("valueBoolean", F.lit(True))
    r.assign("valueString", F.when(s["s_acctbal"] > 0, s["s_name"]))
    rows = s.select("s_suppkey", r.column().alias("r"))
    return rows.select("s_suppkey", F.col("r.valueString").alias("value"), (~F.to_json("r").contains("valueBoolean")).alias("only_last"))


@query("select p_partkey, count(*) over (partition by p_brand) as same_brand from part")
def grouped_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping across rows by a computed key, each row keeping its place."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return sq.counted_by(p, "p_brand", "same_brand").select("p_partkey", "same_brand")


@query(
    f"""select c_custkey, concat('urn:uuid:', {_uuid_sql("concat('{\"resourceType\":\"Basic\",\"id\":\"', c_custkey, '\",\"balance\":', regexp_replace(cast(c_acctbal as varchar), '[.]0$', ''), ',\"ten\":', cast(c_custkey as bigint) * 10000000, '}')")}) as full_url
    from customer"""
)
def content_link_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link of a resource with numbers, which are written as JSON writes them."""
    c = _t(spark, sf_dir, "customer")
    ten = (F.col("c_custkey") * 10_000_000).cast("double")
    basic = F.struct(F.lit("Basic").alias("resourceType"), F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").cast("double").alias("balance"), ten.alias("ten"))
    rows = c.select("c_custkey", basic.alias("r"))
    return rows.select("c_custkey", sc.content_link(F.col("r"), rows.schema["r"].dataType).alias("full_url"))


@query(
    """select o_orderkey, n >= 2 as ok, case when n < 2 then concat('The FHIR element "note" is mandatory in "Order" (minimum 2), but ',
    case when n = 0 then 'no value was' else '1 value was' end, ' provided.') end as message
    from (select o_orderkey, (case when o_orderstatus = 'F' then 1 else 0 end) + (case when o_orderkey % 2 = 0 then 1 else 0 end) as n from orders)"""
)
def cardinality_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minimum of two values of a repeating element; missing ones don't count."""
    note = F.array(F.when(F.col("o_orderstatus") == "F", "a"), F.when(F.col("o_orderkey") % 2 == 0, "b"))
    check = validation.mandatory(note, "note", "Order", minimum=2, many=True)
    r = _t(spark, sf_dir, "orders").select("o_orderkey", diag.report(note, diag.gathered(check)).alias("r"))
    return r.select("o_orderkey", "r.ok", diag.primary(F.col("r"))["message"].alias("message"))


@query(
    """select o_orderkey, o_orderstatus <> 'P' as ok, case when o_orderstatus <> 'P' then 200 else 206 end as status,
    case when o_orderstatus = 'P' then 'The FHIR element "status" is mandatory in "Observation" (minimum 1), but no value was provided.' end as message,
    case when o_orderstatus = 'P' then 'MIN' end as code from orders"""
)
def mandatory_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource's mandatory elements are checked by the engine; the older error shape."""
    from tessella.engine import Engine

    def mapping(d: DataFrame, b) -> Resource:
        status = F.when(d["o_orderstatus"] != "P", d["o_orderstatus"])
        return Resource(profiles.OBSERVATION, d["o_orderkey"]).assign("status", status).assign("code.text", F.concat(F.lit("o"), d["o_orderpriority"]))

    r = Engine().transform_checked(_t(spark, sf_dir, "orders"), mapping, output="r")
    e = diag.legacy_error(F.col("r"))
    return r.select("o_orderkey", "r.ok", "r.status", e["message"].alias("message"), e["code"].alias("code"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey in (select p_partkey from part where p_size > 25) as large from lineitem")
def value_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a value set of any size."""
    members = _t(spark, sf_dir, "part").filter(F.col("p_size") > 25).select(F.col("p_partkey").alias("code"))
    rows = terminology.with_membership(_t(spark, sf_dir, "lineitem"), None, "l_partkey", members, "large")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "large")


@query(
    """select o_orderkey, case o_orderstatus when 'F' then 'gram' when 'O' then 'kilogram' end as unit,
    case o_orderstatus when 'F' then 'g' when 'O' then 'alpha' end as target from orders"""
)
def unit_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantity's unit name from its code; of several targets of a map, the smallest."""
    ucum = "http://unitsofmeasure.org"
    unit = F.lit(None).cast("string")
    known = {(ucum, "F"): "gram", (ucum, "O"): "kilogram"}
    rows = _t(spark, sf_dir, "orders").withColumn("unit", validation.injected_unit(unit, F.lit(ucum), F.col("o_orderstatus"), known))
    maps = spark.createDataFrame([("F", "g"), ("O", "beta"), ("O", "alpha")], "code string, target_code string")
    return terminology.translate(rows, "o_orderstatus", maps, "target").select("o_orderkey", "unit", "target")


@query(
    """select o_custkey, string_agg(w, ' ' order by o_orderkey, i) as words from (
    select o_custkey, o_orderkey, generate_subscripts(string_split(o_orderpriority, '-'), 1) as i, unnest(string_split(o_orderpriority, '-')) as w from orders) group by o_custkey"""
)
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path over fields that repeat gives one flat sequence."""
    o = _t(spark, sf_dir, "orders")
    words = F.struct(F.col("o_orderkey").alias("key"), F.struct(sc.split_text(F.col("o_orderpriority"), "-").alias("word")).alias("priority"))
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(words)).alias("orders"))
    return rows.select("o_custkey", sc.join_list(sq.walk(F.col("orders"), "priority", "word*"), " ").alias("words"))


_SAVED = """
Instance: concat('o', o_orderkey)
InstanceOf: Observation
* status = case when o_orderstatus = 'F' then $done end
* code
  * text = o_orderpriority
* subject.reference = concat('Patient/', o_custkey)
* valueString = 'first'
* valueBoolean = o_totalprice > 100000
* (split(o_orderpriority, '-')).component
  * text = upper(it)
"""


@query(
    """select o_orderkey, concat('o', o_orderkey) as id, case when o_orderstatus = 'F' then 'final' end as status, o_orderpriority as code,
    concat('Patient/', o_custkey) as subject, o_totalprice > 100000 as large, upper(split_part(o_orderpriority, '-', 2)) as second,
    o_orderstatus = 'F' as ok from orders"""
)
def saved_mapping_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping saved as rule lines, with Spark SQL for its expressions, run by name."""
    from tessella.engine import Engine

    engine = Engine(bindings={"done": "final"})
    engine.load_mappings(spark.createDataFrame([("obs", "file", _SAVED)], "key string, source string, expression string"))
    r = engine.transform_verbose(_t(spark, sf_dir, "orders"), "obs", output="r").select("o_orderkey", "r.ok", "r.result.*")
    return r.select(
        "o_orderkey", "id", "status", F.col("code.text").alias("code"), F.col("subject.reference").alias("subject"), F.col("valueBoolean").alias("large"),
        sq.item(F.col("component"), 1)["text"].alias("second"), "ok",
    )
