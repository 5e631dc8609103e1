"""Goldens of the mapping side: ids, converters, HL7 rules, thresholds, registry, streaming."""

import decimal
import json

import duckdb
import pytest
from pyspark.sql import functions as F
from tessella.config import Config, log_level
from tessella.engine import Engine, MappingNotFound, NoMappingSource
from tessella.functions import scalar as sc
from tessella.functions import sequence as sq
from tessella.operators import diagnostics as diag
from tessella.operators import invocation, profiles, validation
from tessella.operators.resource import Resource, entry
from tessella.operators.rules import RuleError, rule_mapping
from tessella.plans import catalog
from tessella.sources import documents, hl7v2, registry
from tessella.streaming.mapping import refreshed_batches, stream_mapping


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("seed,want", [("1", "356a192b-7913-504c-9457-4d18c28d46e6")])
def test_seeded_uuid(spark, seed, want):
    assert one(spark, sc.seeded_uuid(F.col("x")), seed) == want


def test_content_link_follows_field_order(spark):
    a = F.struct(F.lit("Patient").alias("resourceType"), F.lit("1").alias("id"), F.lit(None).cast("string").alias("none"))
    b = F.struct(F.lit("1").alias("id"), F.lit("Patient").alias("resourceType"))
    left, right = one(spark, sc.content_link(a)), one(spark, sc.content_link(b))
    assert left != right and left == "urn:uuid:" + one(spark, sc.seeded_uuid(F.lit('{"resourceType":"Patient","id":"1"}')))
    assert one(spark, entry(a)).fullUrl == left


def test_csv_text(spark):
    text = 'field1, field2, field3\na,true,null\nb,"x, ""y"""\r\n'
    assert one(spark, documents.csv_objects(F.col("x")), text) == [{"field1": "a", "field2": "true", "field3": "null"}, {"field1": "b", "field2": 'x, "y"'}]
    assert one(spark, documents.csv_objects(F.col("x")), "a,b") == []


def test_csv_text_keeps_cells_beside_empty_ones_and_quoted_line_ends(spark):
    got = lambda text: one(spark, documents.csv_objects(F.col("x")), text)
    assert got("a,b,c\n,x,y\n,,z\n1,,\n,\n") == [
        {"a": "", "b": "x", "c": "y"}, {"a": "", "b": "", "c": "z"}, {"a": "1", "b": "", "c": ""}, {"a": "", "b": ""},
    ]
    assert got(",b\n1,2") == [{"": "1", "b": "2"}]
    assert got('a,b\r\n"x\r\ny, ""z""\n",2\r\n\r\n"",3\r') == [{"a": 'x\r\ny, "z"\n', "b": "2"}, {"a": "", "b": "3"}]
    assert got('a,b\n5" x,"' + "q," * 20000 + '"') == [{"a": '5" x', "b": "q," * 20000}]
    assert got('a\n"' + '""' * 20000 + '"\n"open') == [{"a": '"' * 20000}, {"a": '"open'}]
    assert got(None) is None and got("") == []


def test_content_types():
    assert [documents.source_kind(t) for t in (None, "", "application/json+fhir", "text/csv; charset=x", "application/xml+fhir", "x-application/hl7-v2+er7")] == [
        "json", "json", "json", "csv", "xml", "hl7",
    ]
    for bad in ("text/plain", "Application/JSON"):
        with pytest.raises(ValueError, match="Unsupported Content-Type"):
            documents.source_kind(bad)


#: Made up for these tests: a sleep laboratory's report on nobody.
MESSAGE = (
    "MSH|^~\\&|PolySuite^77|SleepLab|Archive||201911302359||ORU^R01|sleep-0007|T|2.5.1\r"
    "PID|4||N-880^^^^PI||Quill^Ada^M||19710228|X|||7 Harbour Row^^Port Vell^^08003||||||||\r"
    "OBX|1|NM|93832-4^Sleep duration^LN||412|min||^||N|P\nOBX|2|NM|^^||17||||||||||||||201912010630|late note"
)


def test_hl7_rules(spark):
    got = json.loads(one(spark, hl7v2.to_json(F.col("x"), ["MSH", "PID", "PV1", "OBX"]), MESSAGE))
    assert got["MSH"]["DateTimeOfMessage"] == {"Time": "2019-11-30T23:59"} and got["MSH"]["EncodingCharacters"] == "^~\\&"
    assert got["MSH"]["SendingApplication"] == {"NamespaceID": "PolySuite", "UniversalID": "77"} and got["MSH"]["MessageControlID"] == "sleep-0007"
    assert got["PID"] == {
        "SegmentDescription": "Patient Identification", "MessageLine": 2, "SetID": "4",
        "PatientIdentifierList": {"IDNumber": "N-880", "IdentifierTypeCode": "PI"},
        "PatientName": {"FamilyName": {"Surname": "Quill"}, "GivenName": "Ada"}, "DateTimeOfBirth": {"Time": "1971-02-28"}, "AdministrativeSex": "X",
        "PatientAddress": {"StreetAddress": {"StreetOrMailingAddress": "7 Harbour Row"}, "City": "Port Vell", "ZipOrPostalCode": "08003"},
    }
    assert "PV1" not in got and [o["MessageLine"] for o in got["OBX"]] == [3, 4]
    assert "ObservationIdentifier" not in got["OBX"][1] and got["OBX"][1]["OBX20"] == "late note" and got["OBX"][0]["ObservationValue"] == "412"


def test_hl7_older_version_keeps_digits(spark):
    text = "MSH|^~\\&|Balance^B9||||19980704||ORU^R01|w-3|P|2.3||x^y||||||zz||\nNTE|2|L|weighed twice|end"
    got = json.loads(one(spark, hl7v2.to_json(F.col("x"), ["MSH", "NTE"], "2.3"), text))
    assert got["MSH"]["DateTimeOfMessage"] == {"TimeOfAnEvent": "19980704"} and got["MSH"]["ContinuationPointer"] == "x^y" and got["MSH"]["MSH20"] == "zz"
    assert got["NTE"] == {"SegmentDescription": "Notes and comments segment", "MessageLine": 2, "SetID": "2", "SourceOfComment": "L", "Comment": "weighed twice", "NTE4": "end"}


def test_hl7_picks_the_dictionary_by_message_and_keeps_unknown_segments(spark):
    new = "MSH|^~\\&|A||||20200102||ADT^A01|1|P|2.5.1\rZPT|x||a^b\nNK1|1|Sib^Ling\nZPT|y"
    old = "MSH|^~\\&|A||||20200102||ADT^A01|1|P|2.3\nNTE|1|L|text"
    got = [json.loads(r.j) for r in spark.createDataFrame([(new,), (old,)], "x string").select(hl7v2.to_json(F.col("x")).alias("j")).collect()]
    assert got[0]["MSH"]["DateTimeOfMessage"] == {"Time": "2020-01-02"} and got[0]["NK1"] == {"MessageLine": 3, "NK11": "1", "NK12": "Sib^Ling"}
    assert got[0]["ZPT"] == [{"MessageLine": 2, "ZPT1": "x", "ZPT3": "a^b"}, {"MessageLine": 4, "ZPT1": "y"}]
    assert got[1]["MSH"]["DateTimeOfMessage"] == {"TimeOfAnEvent": "20200102"} and got[1]["NTE"]["Comment"] == "text"
    assert one(spark, hl7v2.to_json(F.col("x")), None) is None


def test_hl7_message_is_cut_once(spark):
    df = spark.createDataFrame([("",)], "x string").select(hl7v2.to_json(F.col("x")).alias("j"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(x#") == 1


def test_hl7_odd_messages_as_json(spark):
    text = "OBX|1|^\nMSH|^~\\&|A^&u&v||||2020||^|1||2.3^x\nEVN\nOBX|2||&|||u&^v^|zz"
    got = json.loads(one(spark, hl7v2.to_json(F.col("x")), text))
    assert list(got) == ["MSH", "OBX", "EVN"] and got["EVN"] == {"MessageLine": 3}
    assert got["MSH"]["SendingApplication"] == {"NamespaceID": "A", "UniversalID": "&u&v"} and "MessageType" not in got["MSH"]
    assert got["OBX"][0] == {"SegmentDescription": "Observation segment", "MessageLine": 1, "SetID": "1", "ValueType": "^"}
    assert got["OBX"][1]["Units"] == {"Identifier": "u&", "Text": "v"} and got["OBX"][1]["ReferencesRange"] == "zz"
    assert one(spark, hl7v2.to_json(F.col("x"), []), text) == "{}" and one(spark, hl7v2.to_json(F.col("x")), "") == "{}"


def test_xml_values(spark):
    x = documents.xml_document(F.col("x"), "given string, family struct<_value:string>")
    row = one(spark, x, '<root><given>A</given><family value="B"/></root>')
    assert (row.given, row.family["_value"]) == ("A", "B")


def test_sequences(spark):
    a = F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))
    assert one(spark, sq.last(a)) == "b" and one(spark, sq.item(a, 7)) is None
    assert one(spark, sq.each(a, F.upper)) == ["A", "B"]
    assert one(spark, sq.appended(F.lit(None).cast("array<string>"))) is None
    assert one(spark, sq.keyed(F.array(F.lit("a"), F.lit("b")), lambda v, i: F.lit("k"))) == {"k": "b"}


def test_paths_over_repeating_fields_are_flattened(spark):
    kind = "array<struct<name:array<struct<given:array<string>,family:string>>>>"
    people = [{"name": [{"given": ["A", "B"], "family": "X"}, {"given": None, "family": None}]}, {"name": None}, {"name": [{"given": ["C"], "family": "Y"}]}]
    assert one(spark, sq.walk(F.col("x"), "name*", "given*"), people, kind) == ["A", "B", "C"]
    assert one(spark, sq.walk(F.col("x"), "name*", "family"), people, kind) == ["X", "Y"]


def test_keys_that_repeat_or_are_missing(spark):
    values = F.split(F.col("x"), ",")
    key = lambda v, i: F.when(v != "none", F.substring(v, 1, 1))
    assert one(spark, sq.keyed(values, key), "a1,b1,none,a2") == {"a": "a2", "b": "b1"}
    assert one(spark, sq.keyed(values, key), "none") == {} and one(spark, sq.keyed(values, key)) is None
    many = ",".join(f"{i % 3000}" for i in range(30_000))
    got = one(spark, sq.keyed(values, lambda v, i: v), many)
    assert len(got) == 3000 and len(one(spark, sq.grouped(values, lambda v, i: v), many)["7"]) == 10


@pytest.mark.parametrize(
    "value,kind,want",
    [
        ("v1.0", "string", "v1.0"), (12345678.0, "double", "12345678"), (0.1, "double", "0.1"), (120.0, "double", "120"), (1e21, "double", "1e+21"),
        (1.5e-7, "double", "1.5e-7"), (-2.5, "float", "-2.5"), (123456789012345680000.0, "double", "123456789012345680000"), (0.0, "double", "0"), (7, "int", "7"),
        (True, "boolean", "true"), (None, "double", None),
    ],
)
def test_numbers_are_written_as_in_json(spark, value, kind, want):
    assert one(spark, sc.text(F.col("x")), value, kind) == want


def test_json_text_writes_numbers_plainly(spark):
    kind = "struct<a:double,b:array<double>,c:string,d:struct<e:double>,f:decimal(9,3)>"
    row = {"a": 12345678.0, "b": [1.0, 0.5], "c": 'x "1.0" \\u0001', "d": None, "f": None}
    df = spark.createDataFrame([(row,)], f"x {kind}")
    text = df.select(sc.json_text(F.col("x"), df.schema["x"].dataType).alias("y")).first().y
    assert text == '{"a":12345678,"b":[1,0.5],"c":"x \\"1.0\\" \\\\u0001"}'


def test_json_text_keeps_the_sign_of_zero(spark):
    kind = "struct<a:double,b:array<float>,c:decimal(9,3),d:double>"
    df = spark.createDataFrame([({"a": -0.0, "b": [-0.0, 0.0], "c": decimal.Decimal("-0.000"), "d": -0.5},)], f"x {kind}")
    text = df.select(sc.json_text(F.col("x"), df.schema["x"].dataType).alias("y")).first().y
    assert text == '{"a":-0,"b":[-0,0],"c":0,"d":-0.5}'


def test_content_link_numbers_equals_sql_at_negative_zero(spark, tmp_path):
    rows = [(0, -0.0), (1, 0.0), (14999, -0.01), (899999, 9999.99)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = {tuple(r) for r in catalog.queries()["content_link_numbers"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(catalog.oracle_sql()["content_link_numbers"]).fetchall())


@pytest.mark.parametrize(
    "kind,value,want", [("string", "", False), ("string", "a", True), ("boolean", False, False), ("double", 0.0, False), ("double", 2.0, True), ("array<string>", [""], False), ("array<string>", [], False), ("array<string>", ["", "b"], True)]
)
def test_truthiness(spark, kind, value, want):
    name = {"double": "number", "array<string>": "array"}.get(kind, kind)
    assert one(spark, sc.truthy(F.col("x"), name), value, kind) is want
    assert one(spark, sc.truthy(F.col("x"), name), None, kind) is False


def test_grouped_keeps_every_value_of_a_repeated_key(spark):
    values = F.split(F.col("x"), ",")
    got = one(spark, sq.grouped(values, lambda v, i: F.when(v != "none", F.substring(v, 1, 1))), "a1,b1,none,a2,a1")
    assert got == {"a": ["a1", "a2", "a1"], "b": ["b1"]}
    assert one(spark, sq.grouped(F.split(F.col("x"), ","), lambda v, i: v)) is None


def test_rules(spark):
    r = Resource(profiles.PATIENT, F.lit("7")).assign("gender", F.lit("x")).assign("gender", F.lit("female")).assign("active", F.lit(False))
    r.assign("deceasedBoolean", F.lit(True)).assign("deceasedDateTime", F.lit("2020")).slice("identifier", "ssn").sibling("birthDate", F.struct(F.lit("y").alias("z")))
    got = json.loads(one(spark, F.to_json(r.column())))
    assert list(got) == ["resourceType", "id", "identifier", "active", "gender", "_birthDate", "deceasedDateTime"]
    assert got["gender"] == "female" and got["active"] is False and got["identifier"] == [{"system": "http://hl7.org/fhir/sid/us-ssn"}]
    with pytest.raises(KeyError):
        r.assign("nothing", F.lit(1))


def test_root_content_nested_rules_and_extensions(spark):
    from tessella.operators.resource import Extension

    kin = Extension("urn:x:kin", "valueCode")
    r = Resource(profiles.BLOOD_PRESSURE).assign("status", F.lit("final")).assign("subject.identifier.value", F.col("x"))
    r.slice("component", "SystolicBP", value=F.lit(118)).slice("component", "DiastolicBP", value=F.lit(None).cast("int"))
    got = json.loads(one(spark, F.to_json(r.column()), "m1"))
    assert list(got) == ["resourceType", "meta", "status", "category", "code", "subject", "component"]
    assert got["code"] == {"coding": [{"system": "http://loinc.org", "code": "85354-9"}]} and got["category"][0]["coding"][0]["code"] == "vital-signs"
    assert got["subject"] == {"identifier": {"value": "m1"}} and len(got["component"]) == 1
    assert got["component"][0]["valueQuantity"] == {"value": 118, "unit": "millimeter of mercury", "system": "http://unitsofmeasure.org", "code": "mm[Hg]"}
    assert "subject" not in json.loads(one(spark, F.to_json(r.column())))
    again = Resource(profiles.BLOOD_PRESSURE).assign("code.coding", F.array(F.struct(F.lit("85354-9").alias("code"))))
    assert json.loads(one(spark, F.to_json(again.column())))["code"] == {"coding": [{"code": "85354-9"}]}
    p = Resource(profiles.PATIENT).extension(kin, F.col("x")).assign("name.family", F.lit("Q")).assign("name.given", F.array(F.lit("Z")))
    got = json.loads(one(spark, F.to_json(p.column()), "aunt"))
    assert got["extension"] == [{"url": "urn:x:kin", "valueCode": "aunt"}] and got["name"] == [{"family": "Q", "given": ["Z"]}]
    assert "extension" not in json.loads(one(spark, F.to_json(p.column())))


def test_mandatory_elements_are_checked_by_themselves(spark):
    docs = spark.createDataFrame([("final",), (None,)], "v string")
    make = lambda d, b: Resource(profiles.OBSERVATION).assign("status", d["v"]).assign("code", F.struct(F.lit("c").alias("text")))
    engine = Engine()
    got = [r.report for r in engine.transform_verbose(docs, make).collect()]
    assert [g.ok for g in got] == [True, False] and got[1].diagnostics.error[0].fhirElement == "status"
    assert [r.result.status for r in engine.transform(docs, make).collect()] == ["final", None]
    assert one(spark, validation.mandatory(F.array().cast("array<string>"), "name", "P", many=True)).message.endswith("(minimum 1), but no value was provided.")
    assert one(spark, validation.mandatory(F.array(F.lit("a")), "name", "P", minimum=2, many=True)).message.endswith("(minimum 2), but 1 value was provided.")
    assert one(spark, validation.mandatory(F.array(F.lit("a")), "name", "P", many=True)) is None
    warned = lambda d: [diag.warn(F.lit("w"))]
    kept = engine.transform_checked(docs, make, warned).collect()
    assert all(r.report.diagnostics.warning == [] for r in kept)
    error = engine.transform_verbose(docs, make).select(diag.legacy_error(F.col("report")).alias("e")).collect()
    assert error[0].e is None and len(error[1].e) == 11 and error[1].e.code == "MIN" and error[1].e["__isMappingError"] is False


def test_membership_and_smallest_targets(spark):
    rows = spark.createDataFrame([(1, "s", "a"), (2, "s", "z"), (3, "t", "a"), (4, None, None)], "k int, sys string, code string")
    members = spark.createDataFrame([("s", "a"), ("s", "a"), (None, "z")], "system string, code string")
    from tessella.operators import terminology

    got = {r.k: r.ok for r in terminology.with_membership(rows, "sys", "code", members, "ok").collect()}
    assert got == {1: True, 2: False, 3: False, 4: None}
    maps = spark.createDataFrame([("a", "y"), ("a", "x")], "code string, target_code string")
    assert {r.k: r.to for r in terminology.translate(rows, "code", maps, "to").collect()} == {1: "x", 2: None, 3: "x", 4: None}
    checked = rows.withColumn("ok", F.lit(False)).select(validation.required_code(F.col("code"), None, "p", "P", ok=F.col("ok"))["code"].alias("c"))
    assert [r.c for r in checked.collect()] == ["F5120", "F5120", "F5120", None]
    unit = validation.injected_unit(F.lit(None).cast("string"), F.lit("u"), F.lit("kg"), {("u", "kg"): "kilogram"})
    assert one(spark, unit) == "kilogram"


@pytest.mark.parametrize("value,want", [("125", 125.0), (" -1.25e2 ", -125.0), ("0.123456789", 0.123456789), (".5", 0.5), ("1d", None), ("NaN", None), ("", None)])
def test_decimals_keep_their_digits(spark, value, want):
    assert one(spark, validation.to_decimal(F.col("x")), value) == want


SAVED = """
  // a made-up mapping
  Instance: concat('p', k)
  InstanceOf: Patient
  * active = k > 1 // a comment
  * name
    * family = concat($prefix, n)
    * given = array('http://x', "$prefix")
  * identifier[ssn]
  * identifier[mrn].value = cast(k as string)
  * (parts).address
    * text = upper(it)
  * birthDate = nullif(n, 'b')
"""


def test_documents_of_mixed_types(spark):
    rows = [("a,b\n1,", "text/csv; charset=utf-8"), ('{"a":1}', None), ("MSH|^~\\&|Z\rZZ1|v", "x-application/hl7-v2+er7"), ("<a/>", "application/xml"), ("x", "text/plain")]
    got = [r.j for r in spark.createDataFrame(rows, "x string, t string").select(documents.as_json(F.col("x"), F.col("t")).alias("j")).collect()]
    assert json.loads(got[0]) == [{"a": "1", "b": ""}] and got[1] == '{"a":1}' and json.loads(got[2])["ZZ1"] == {"MessageLine": 2, "ZZ11": "v"}
    assert got[3:] == [None, None]


def test_saved_mapping_runs(spark, tmp_path):
    (tmp_path / "pat.map").write_text(SAVED)
    engine = Engine(Config(mappings_folder=str(tmp_path)), {"prefix": "O'"})
    assert engine.load_mappings(registry.folder(spark, f"file://{tmp_path}")) == ["pat"]
    docs = spark.createDataFrame([(1, "a", ["x", None, "y"]), (2, "b", None)], "k int, n string, parts array<string>")
    got = [json.loads(r.j) for r in engine.transform(docs, "pat").select(F.to_json("result").alias("j")).collect()]
    assert got[0] == {
        "resourceType": "Patient", "id": "p1", "active": False, "name": [{"family": "O'a", "given": ["http://x", "$prefix"]}], "birthDate": "a",
        "identifier": [{"system": "http://hl7.org/fhir/sid/us-ssn"}, {"system": "http://example.com/identifier/mrn", "value": "1"}],
        "address": [{"text": "X"}, {"text": "Y"}],
    }
    assert "address" not in got[1] and "birthDate" not in got[1] and got[1]["active"] is True
    bp = rule_mapping("InstanceOf: bp\n* status = 'final'\n* component[SystolicBP].value = k\n* component[DiastolicBP].value = null", profiles.PROFILES)
    row = json.loads(engine.transform(docs, bp).select(F.to_json("result").alias("j")).first().j)
    assert [c["valueQuantity"]["value"] for c in row["component"]] == [1] and row["code"]["coding"][0]["code"] == "85354-9"


@pytest.mark.parametrize("text,said", [("* a = 1", "no InstanceOf"), ("InstanceOf: Nobody", "line 1: unknown profile"), ("InstanceOf: Patient\nactive = 1", "line 2 is not a rule")])
def test_rule_errors_name_the_line(text, said):
    with pytest.raises(RuleError, match=said):
        rule_mapping(text, profiles.PROFILES)


def test_choice_shorthand(spark):
    from tessella.operators.resource import Element, Profile

    only = Profile("Extension", elements=(Element("valueCode", choices=("valueCode",)),))
    assert json.loads(one(spark, F.to_json(Resource(only).assign("valueCode", F.lit("a")).column())))["valueCode"] == "a"
    only = Profile("Extension", elements=(Element("value", choices=("valueCode",)),))
    assert json.loads(one(spark, F.to_json(Resource(only).assign("value[x]", F.lit("a")).column())))["valueCode"] == "a"
    with pytest.raises(ValueError, match="needs a type"):
        Resource(profiles.OBSERVATION).assign("value", F.lit(1))


def test_messages(spark):
    codings = F.array(F.struct(F.lit("s").alias("system"), F.lit("c").alias("code")))
    d = one(spark, validation.required_concept(codings, F.lit(False), "day.value", "Condition"))
    assert (d.code, d.level) == ("F5123", "invalid")
    assert d.message == 'CodeableConcept.coding does not contain a Coding from the required ValueSet (1 provided) for "day.value" in "Condition".'
    unit = one(spark, validation.required_unit(F.lit("u"), F.lit("x"), [("u", "kg")], "valueQuantity", "Weight"))
    assert unit.message == 'Quantity unit code (system="u", code="x") for "valueQuantity" in "Weight" is not in the required ValueSet.'
    assert one(spark, validation.to_decimal(F.col("x")), "abc") is None


def test_thresholds(spark):
    found = diag.gathered(diag.warn(F.lit("careful")))
    low = one(spark, diag.report(F.lit("r"), found))
    assert low.ok and low.status == 200 and low.diagnostics.warning[0].code == "F5320"
    strict = one(spark, diag.report(F.lit("r"), found, diag.Thresholds().override(throw=40)))
    assert not strict.ok and strict.status == 206
    assert one(spark, diag.report(F.lit(None).cast("string"), found, diag.Thresholds(throw=40))).status == 422
    quiet = one(spark, diag.report(F.lit("r"), found, diag.Thresholds(collect=30)))
    assert quiet.diagnostics.warning == []
    assert one(spark, diag.synthetic("NO_EXPRESSION", "nothing", 400)).diagnostics.error[0].severity == 1
    assert one(spark, diag.normalized(F.lit(None).cast(f"struct<ok:boolean,status:int,result:string,diagnostics:struct<error:array<{diag.DIAGNOSTIC}>,warning:array<{diag.DIAGNOSTIC}>,debug:array<{diag.DIAGNOSTIC}>>>"))).status == 500


def test_engine(spark):
    docs = spark.createDataFrame([("a",), (None,)], "v string")
    engine = Engine(Config(), {"mark": "!"})
    with pytest.raises(NoMappingSource):
        engine.transform(docs, "m")
    engine.register_mapping("m", lambda d, b: sc.join_present(d["v"], b["mark"]))
    assert [r.result for r in engine.transform(docs, "m").collect()] == ["a!", "!"]
    assert [r.result for r in engine.transform(docs, "m", mark="?").collect()] == ["a?", "?"] and engine.bindings["mark"] == "!"
    with pytest.raises(MappingNotFound, match="Mapping 'n' not found"):
        engine.transform(docs, "n")
    with pytest.raises(TypeError):
        engine.register_mapping("bad", "text")
    checks = lambda d: [validation.mandatory(d["v"], "v", "P")]
    assert [r.report.ok for r in engine.transform_verbose(docs, "m", checks).collect()] == [True, False]
    assert [r.report.ok for r in engine.transform_verbose(docs, "m", checks, validation=10).collect()] == [True, True]
    assert engine.info()["packages"] == ["hl7.fhir.r4.core@4.0.1"]


def test_config_and_levels():
    assert Config(mappings_folder=" n/a ").stateless and not Config(mappings_folder="/x").stateless
    with pytest.raises(ValueError):
        Config(thresholds=diag.Thresholds(throw=-1))
    assert log_level(" Warning ") == 30 and log_level("loud") is None and log_level(3) is None


def test_registry(spark, tmp_path):
    (tmp_path / "my map.map").write_text("InstanceOf: Patient\n* active = true")
    (tmp_path / "s.json").write_text(
        json.dumps({"resourceType": "StructureMap", "id": "k", "group": [{"rule": [{"extension": [{"url": "u", "valueExpression": {"language": "l", "expression": "$"}}]}]}]})
    )
    assert [tuple(r) for r in registry.folder(spark, f"file://{tmp_path}").collect()] == [("my map", "file", "InstanceOf: Patient\n* active = true")]
    assert registry.folder(spark, "n/a").count() == 0
    assert [tuple(r) for r in registry.structure_maps(spark, f"file://{tmp_path}/*.json").collect()] == [("k", "server", "$")]
    assert registry.static_values(spark, f"file://{tmp_path}")["s"]["id"] == "k"
    maps = spark.createDataFrame(
        [("Aliases", [{"element": [{"code": "ssn", "target": [{"code": "urn:ssn"}]}]}])], "name string, group array<struct<element:array<struct<code:string,target:array<struct<code:string>>>>>>"
    )
    assert registry.aliases(maps, "Aliases") == {"ssn": "urn:ssn"}
    assert registry.packages(" a@1, ,b@2") == ["hl7.fhir.r4.core@4.0.1", "a@1", "b@2"]


def test_invocation(spark):
    assert one(spark, invocation.subroute(F.col("x"), F.lit("m")), "/m/a//b/") == ["a", "b"]
    assert one(spark, invocation.subroute(F.col("x"), F.lit("m")), "/m") == []
    assert one(spark, invocation.wants_report(F.array(F.lit("no"), F.lit(" TRUE ")))) is True


def test_stream(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([("a",), ("b",)], "v string").write.parquet(source)
    docs = spark.readStream.schema("v string").parquet(source)
    engine, seen, loads = Engine(), [], []
    mapped = lambda d: stream_mapping(engine, d, lambda x, b: sc.join_present(x["v"], "!"))
    q = refreshed_batches(docs, mapped, lambda: loads.append(1), lambda d, n: seen.extend(r.result for r in d.collect()), f"file://{tmp_path}/cp", None)
    q.awaitTermination(60)
    assert sorted(seen) == ["a!", "b!"] and not loads
    again = refreshed_batches(docs, mapped, lambda: loads.append(1), lambda d, n: d.count(), f"file://{tmp_path}/cp2", 1e-9)
    again.awaitTermination(60)
    assert loads == [1]
