"""HL7 v2 messages as nested columns.

Names come from a dictionary for each version, limited to the segments and fields listed
here; a field or segment that isn't listed is kept raw under its segment and number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names: composite types as {component: name or (name, type)}.
TYPES = {
    "2.5.1": {
        "HD": {1: "NamespaceID", 2: "UniversalID", 3: "UniversalIDType"},
        "TS": {1: ("Time", "iso")},
        "MSG": {1: "MessageCode", 2: "TriggerEvent", 3: "MessageStructure"},
        "PT": {1: "ProcessingID"},
        "VID": {1: "VersionID"},
        "CX": {1: "IDNumber", 4: ("AssigningAuthority", "HD"), 5: "IdentifierTypeCode"},
        "FN": {1: "Surname"},
        "XPN": {1: ("FamilyName", "FN"), 2: "GivenName"},
        "SAD": {1: "StreetOrMailingAddress"},
        "XAD": {1: ("StreetAddress", "SAD"), 3: "City", 4: "StateOrProvince", 5: "ZipOrPostalCode"},
        "XTN": {1: "TelephoneNumber"},
        "PL": {1: "PointOfCare", 2: "Room", 3: "Bed", 4: ("Facility", "HD")},
        "XCN": {1: "IDNumber", 2: ("FamilyName", "FN"), 3: "GivenName"},
        "CE": {1: "Identifier", 2: "Text", 3: "NameOfCodingSystem"},
        "EI": {1: "EntityIdentifier"},
        "XON": {1: "OrganizationName"},
    },
    "2.3": {
        "HD": {1: "NamespaceID", 2: "UniversalID", 3: "UniversalIDType"},
        "TS": {1: "TimeOfAnEvent"},
        "MSG": {1: "MessageType", 2: "TriggerEvent"},
        "PT": {1: "ProcessingID"},
        "EI": {1: "EntityIdentifier"},
        "XCN": {1: "IDNumber", 2: "FamilyName", 3: "GivenName"},
        "CE": {1: "Identifier", 2: "Text", 5: "AlternateText"},
    },
}
#: Fixed names: (description, {field: name or (name, type)}) of each segment.
SEGMENTS = {
    "2.5.1": {
        "MSH": (
            "Message Header",
            {
                3: ("SendingApplication", "HD"), 4: ("SendingFacility", "HD"), 5: ("ReceivingApplication", "HD"), 6: ("ReceivingFacility", "HD"),
                7: ("DateTimeOfMessage", "TS"), 9: ("MessageType", "MSG"), 10: "MessageControlID", 11: ("ProcessingID", "PT"), 12: ("VersionID", "VID"),
            },
        ),
        "EVN": ("Event Type", {1: "EventTypeCode", 2: ("RecordedDateTime", "TS")}),
        "PID": (
            "Patient Identification",
            {
                1: "SetID", 2: ("PatientID", "CX"), 3: ("PatientIdentifierList", "CX"), 5: ("PatientName", "XPN"), 7: ("DateTimeOfBirth", "TS"),
                8: "AdministrativeSex", 11: ("PatientAddress", "XAD"), 12: "CountyCode", 13: ("PhoneNumber_Home", "XTN"),
                14: ("PhoneNumber_Business", "XTN"), 18: ("PatientAccountNumber", "CX"),
            },
        ),
        "PV1": (
            "Patient Visit",
            {
                1: "SetID", 2: "PatientClass", 3: ("AssignedPatientLocation", "PL"), 4: "AdmissionType", 7: ("AttendingDoctor", "XCN"),
                10: "HospitalService", 14: "AdmitSource", 17: ("AdmittingDoctor", "XCN"), 19: ("VisitNumber", "CX"), 44: ("AdmitDateTime", "TS"),
            },
        ),
        "DG1": (
            "Diagnosis",
            {
                1: "SetID", 2: "DiagnosisCodingMethod", 3: ("DiagnosisCode_DG1", "CE"), 4: "DiagnosisDescription", 5: ("DiagnosisDateTime", "TS"),
                6: "DiagnosisType", 19: ("AttestationDateTime", "TS"), 20: ("DiagnosisIdentifier", "EI"), 21: "DiagnosisActionCode",
            },
        ),
        "IN1": (
            "Insurance",
            {
                1: "SetID", 2: ("InsurancePlanID", "CE"), 3: ("InsuranceCompanyID", "CX"), 4: ("InsuranceCompanyName", "XON"),
                5: ("InsuranceCompanyAddress", "XAD"), 15: "PlanType", 19: ("InsuredsAddress", "XAD"),
            },
        ),
        "OBX": (
            "Observation/Result",
            {
                1: "SetID", 2: "ValueType", 3: ("ObservationIdentifier", "CE"), 5: "ObservationValue", 6: ("Units", "CE"), 7: "ReferencesRange",
                10: "NatureOfAbnormalTest", 11: "ObservationResultStatus", 19: ("DateTimeOfTheAnalysis", "TS"),
            },
        ),
    },
    "2.3": {
        "MSH": (
            "Message header segment",
            {
                3: ("SendingApplication", "HD"), 4: ("SendingFacility", "HD"), 5: ("ReceivingApplication", "HD"), 6: ("ReceivingFacility", "HD"),
                7: ("DateTimeOfMessage", "TS"), 9: ("MessageType", "MSG"), 10: "MessageControlID", 11: ("ProcessingID", "PT"), 12: "VersionID",
                14: "ContinuationPointer",
            },
        ),
        "ORC": (
            "Common order segment",
            {
                2: ("PlacerOrderNumber", "EI"), 5: "OrderStatus", 9: ("DateTimeOfTransaction", "TS"), 10: ("EnteredBy", "XCN"),
                12: ("OrderingProvider", "XCN"), 17: ("EnteringOrganization", "CE"),
            },
        ),
        "NTE": ("Notes and comments segment", {1: "SetID", 2: "SourceOfComment", 3: "Comment"}),
        "OBR": ("Observation request segment", {1: "SetID", 3: ("FillerOrderNumber", "EI"), 7: ("ObservationDateTime", "TS")}),
        "OBX": (
            "Observation segment",
            {
                1: "SetID", 2: "ValueType", 3: ("ObservationIdentifier", "CE"), 5: "ObservationValue", 6: ("Units", "CE"), 7: "ReferencesRange",
                8: "AbnormalFlags", 11: "ObservResultStatus",
            },
        ),
    },
}


def _ids(message: Column) -> Column:
    """(line, id, raw) of a message's segments, lines counted from 1."""
    lines = F.filter(F.split(message, "\r\n|\n|\r"), lambda line: line != "")
    return F.transform(lines, lambda line, i: F.struct((i + 1).alias("line"), F.substring(line, 1, 3).alias("id"), line.alias("raw")))


def _fields(segments: Column) -> Column:
    """(line, id, f) of segments, f their fields."""
    return F.transform(segments, lambda s: F.struct(s["line"].alias("line"), s["id"].alias("id"), F.split(s["raw"], "\\|", -1).alias("f")))


def _named(message: Column, name: str) -> Column:
    return _fields(F.filter(_ids(message), lambda s: s["id"] == name))


def _iso(digits: Column) -> Column:
    """yyyyMMddHHmmss digits as ISO text of the same precision."""
    part = lambda mark, at, n: F.when(F.length(digits) >= at + n - 1, F.concat(F.lit(mark), F.substring(digits, at, n)))
    return F.when(digits.isNotNull(), F.concat_ws("", part("", 1, 4), part("-", 5, 2), part("-", 7, 2), part("T", 9, 2), part(":", 11, 2), part(":", 13, 2)))


def _plain(value: Column) -> Column:
    return F.when(value != "", value)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _composite(text: Column, separator: str, kind: str, types: dict) -> Column:
    """Named components of a field's text; null where all of them are."""

    def named(parts: Column) -> Column:
        out, some = [], []
        for n, spec in types[kind].items():
            name, inner = spec if isinstance(spec, tuple) else (spec, None)
            raw = F.get(parts, F.lit(n - 1))
            if inner is None or inner == "iso":
                column = _plain(raw) if inner is None else _bound(_plain(raw), _iso)
            else:
                column = _composite(raw, "&", inner, types)
            out.append(column.alias(name))
            some.append(name)
        return _bound(F.struct(*out), lambda s: F.when(reduce(Column.__or__, [s[n].isNotNull() for n in some]), s))

    return F.when(text != "", _bound(F.split(text, separator, -1), named))


def _built(s: Column, name: str, version: str) -> Column:
    """A segment of ``_fields`` as the struct that the dictionary has for its name."""
    description, fields = SEGMENTS[version].get(name, (None, {}))
    shift = 1 if name == "MSH" else 0  # the separator itself is MSH-1
    out = ([F.lit(description).alias("SegmentDescription")] if description else []) + [s["line"].alias("MessageLine")]
    if name == "MSH":
        out += [F.lit("|").alias("FieldSeparator"), F.get(s["f"], F.lit(1)).alias("EncodingCharacters")]
    for n, spec in fields.items():
        title, kind = spec if isinstance(spec, tuple) else (spec, None)
        field = F.get(s["f"], F.lit(n - shift))
        out.append((_plain(field) if kind is None else _composite(field, "\\^", kind, TYPES[version])).alias(title))
    return F.struct(*out)


def segment(message: Column, name: str, version: str = "2.5.1") -> Column:
    """All segments of one name as an array of structs; empty parts are null.

    A name that the dictionary lacks has its line alone; ``unlisted`` has the fields.
    """
    return F.transform(_named(message, name), lambda s: _built(s, name, version))


def _raw(s: Column, name: str, version: str) -> Column:
    """A map of a segment's non-empty fields that the dictionary lacks, by segment and number."""
    shift = 1 if name == "MSH" else 0
    known = list(SEGMENTS[version].get(name, ("", {}))[1]) + ([1, 2] if name == "MSH" else [])
    numbered = F.transform(s["f"], lambda v, i: F.struct((i + shift).alias("n"), v.alias("v")))
    left = F.filter(numbered, lambda p: (p["n"] > shift) & (p["v"] != "") & ~p["n"].isin(known))
    return F.map_from_entries(F.transform(left, lambda p: F.struct(F.concat(s["id"], p["n"].cast("string")), p["v"])))


def unlisted(message: Column, name: str, version: str = "2.5.1") -> Column:
    """For each segment of one name, a map of its fields that the dictionary lacks."""
    return F.transform(_named(message, name), lambda s: _raw(s, name, version))


def _version(segments: Column) -> Column:
    """The first component of MSH-12."""
    header = F.get(F.filter(segments, lambda s: s["id"] == "MSH"), F.lit(0))
    return F.get(F.split(F.get(header["f"], F.lit(11)), "\\^", -1), F.lit(0))


def message_version(message: Column) -> Column:
    """MSH-12's first component."""
    return _version(_named(message, "MSH"))


def _both(a: Column, b: Column) -> Column:
    """Two JSON objects, the first with members, as one."""
    joined = lambda p: F.concat(F.substring(p["a"], F.lit(1), F.length(p["a"]) - 1), F.lit(","), F.substring(p["b"], F.lit(2), F.length(p["b"])))
    return _bound(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when(p["b"] == "{}", p["a"]).otherwise(joined(p)))


def _object(s: Column, version: str) -> Column:
    """One segment as a JSON object."""
    text = lambda name: _both(F.to_json(_built(s, name, version)), F.to_json(_raw(s, name, version)))
    listed = reduce(lambda found, name: found.when(s["id"] == name, text(name)), SEGMENTS[version], F)
    return listed.otherwise(text(""))


def _members(segments: Column, names: list[str] | None, version: str) -> Column:
    """The JSON object of all ``segments``: each becomes a text once, and these are gathered by name."""
    listed = list(SEGMENTS[version]) if names is None else names
    wanted = segments if names is None else F.filter(segments, lambda s: s["id"].isin(names))

    def member(texts: Column, name: Column) -> Column:
        objects = F.transform(F.filter(texts, lambda t: t["id"] == name), lambda t: t["text"])
        value = lambda o: F.when(F.size(o) == 1, F.get(o, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(o, ","), F.lit("]")))
        return F.concat(F.lit('"'), name, F.lit('":'), _bound(objects, value))

    def gathered(texts: Column) -> Column:
        ids = F.transform(texts, lambda t: t["id"])
        order = F.array_distinct(F.concat(F.array_intersect(F.array(*[F.lit(n) for n in listed]).cast("array<string>"), ids), ids))
        return F.concat(F.lit("{"), F.array_join(F.transform(order, lambda k: member(texts, k)), ","), F.lit("}"))

    return _bound(F.transform(wanted, lambda s: F.struct(s["id"].alias("id"), _object(s, version).alias("text"))), gathered)


def to_json(message: Column, names: list[str] | None = None, version: str | None = None) -> Column:
    """The message as JSON text: a lone segment as an object, repeats as an array.

    All segments, or those of ``names``.  Without a version, each message's own (MSH-12)
    picks the dictionary; the newest serves versions that aren't listed.
    """
    if version is not None:
        return _bound(_fields(_ids(message)), lambda segments: _members(segments, names, version))
    newest = max(SEGMENTS)

    def by_version(p: Column) -> Column:
        older = reduce(lambda found, v: found.when(p["own"] == v, _members(p["s"], names, v)), [v for v in SEGMENTS if v != newest], F)
        return older.otherwise(_members(p["s"], names, newest))

    return _bound(_fields(_ids(message)), lambda segments: _bound(F.struct(segments.alias("s"), _version(segments).alias("own")), by_version))
