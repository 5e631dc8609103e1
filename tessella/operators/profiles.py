"""Small hand-written definitions of the resources and profiles that mappings use here.

They hold order, repetition and fixed content of the elements listed, no more; they are
not the published packages, which aren't available without a network.
"""

from __future__ import annotations

from os.path import commonprefix

from tessella.operators.resource import Element, Profile


#: Elements stand in the order of the standard's definitions (fixed values).
def _elements(*names: str) -> tuple[Element, ...]:
    """``name*`` repeats, ``name!`` is required, ``a|b`` are the types of one choice."""
    out = []
    for n in names:
        many, required = "*" in n, "!" in n
        plain = n.replace("*", "").replace("!", "")
        choices = tuple(plain.split("|")) if "|" in plain else ()
        out.append(Element(commonprefix(choices) if choices else plain, many, required, choices=choices))
    return tuple(out)


PATIENT = Profile(
    "Patient",
    elements=_elements(
        "extension*", "identifier*", "active", "name*", "telecom*", "gender", "birthDate", "deceasedBoolean|deceasedDateTime",
        "address*", "maritalStatus", "contact*", "communication*", "generalPractitioner*", "managingOrganization",
    ),
    slices={
        "identifier[ssn]": {"system": "http://hl7.org/fhir/sid/us-ssn"},
        "identifier[mrn]": {"system": "http://example.com/identifier/mrn"},
    },
)
PRACTITIONER = Profile("Practitioner", elements=_elements("identifier*", "active", "name*", "telecom*", "address*", "gender", "birthDate"))
ORGANIZATION = Profile("Organization", elements=_elements("identifier*", "active", "name", "telecom*", "address*"))
HUMAN_NAME = Profile("HumanName", elements=_elements("use", "text", "family", "given*", "prefix*", "suffix*"), resource=False)
OBSERVATION = Profile(
    "Observation",
    elements=_elements(
        "identifier*", "status!", "category*", "code!", "subject", "effectiveDateTime|effectivePeriod", "issued",
        "valueQuantity|valueCodeableConcept|valueString|valueBoolean", "component*",
    ),
)


def _pressure(code: str) -> dict:
    quantity = {"value": None, "unit": "millimeter of mercury", "system": "http://unitsofmeasure.org", "code": "mm[Hg]"}
    return {"code": {"coding": [{"system": "http://loinc.org", "code": code}]}, "valueQuantity": quantity}


#: The vital-signs blood pressure profile: its canonical url and what it fixes (fixed values).
BLOOD_PRESSURE = Profile(
    "Observation",
    url="http://hl7.org/fhir/StructureDefinition/bp",
    elements=OBSERVATION.elements,
    fixed={
        "category": [
            {"coding": [{"system": "http://terminology.hl7.org/CodeSystem/observation-category", "code": "vital-signs", "display": "Vital Signs"}]}
        ],
        "code": {"coding": [{"system": "http://loinc.org", "code": "85354-9"}]},
    },
    slices={"component[SystolicBP]": _pressure("8480-6"), "component[DiastolicBP]": _pressure("8462-4")},
    shorthand={f"component[{name}].value": "valueQuantity.value" for name in ("SystolicBP", "DiastolicBP")},
)

#: Definitions by type, id and canonical url.
PROFILES = {
    key: p
    for p in (PATIENT, PRACTITIONER, ORGANIZATION, OBSERVATION, HUMAN_NAME, BLOOD_PRESSURE)
    for key in ((p.name, p.url) if p.url else (p.type,))
}
