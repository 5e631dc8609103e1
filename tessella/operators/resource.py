"""Building resources from rules.

Rules are Python calls rather than source text: each names a path and a Column, and
``Profile`` says in which order elements stand, which repeat, and what a slice fixes.
Everything compiles to one struct Column, so Catalyst sees the whole mapping.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tessella.functions.scalar import content_link
from tessella.functions.sequence import appended, last, listed
from tessella.operators.validation import mandatory


@dataclass(frozen=True)
class Element:
    """One element: whether it repeats, whether it must be there, and its children's order."""

    name: str
    many: bool = False
    required: bool = False
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    """A resource type or profile: canonical url (if it is a profile) and elements in order.

    ``fixed`` is what the profile fixes at its root and ``slices`` what each slice does, as
    nested content; None keeps a place for a child that rules may set.  ``shorthand`` names
    children that a slice's constraints settle, such as ``value`` for ``valueQuantity.value``.
    """

    type: str
    url: str | None = None
    elements: tuple[Element, ...] = ()
    slices: dict[str, dict] = field(default_factory=dict, hash=False)
    resource: bool = True
    fixed: dict[str, object] = field(default_factory=dict, hash=False)
    shorthand: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def name(self) -> str:
        """The profile's id, or the type."""
        return self.url.rsplit("/", 1)[-1] if self.url else self.type

    def element(self, name: str) -> Element:
        for e in self.elements:
            if e.name == name.removesuffix("[x]") or name in e.choices:
                return e
        raise KeyError(f"{self.type} has no element {name}")


@dataclass(frozen=True)
class Extension:
    """An extension's definition: its url and the one type of its value, such as ``valueCode``."""

    url: str
    value: str


def literal(content: object) -> Column:
    """Nested content as a Column: dictionaries as structs, lists as arrays."""
    if isinstance(content, dict):
        return F.struct(*[literal(v).alias(k) for k, v in content.items() if v is not None])
    if isinstance(content, list):
        return F.array(*map(literal, content))
    return F.lit(content)


def _names(content: dict, fields: dict[str, Column]) -> list[str]:
    """Members of ``_merged``."""
    heads = dict.fromkeys(path.partition(".")[0] for path in fields)
    return [n for n in dict.fromkeys([*content, *heads]) if n in heads or content[n] is not None]


def _merged(content: dict, fields: dict[str, Column], names: list[str] = ()) -> Column:
    """Fixed content with the values of dotted paths set in it; a list's paths hold for its first item.

    ``names`` are the members of items beside it: they are there in that order, null where
    this one lacks them.
    """
    heads: dict[str, dict[str, Column]] = {}
    for path, value in fields.items():
        head, _, rest = path.partition(".")
        heads.setdefault(head, {})[rest] = value
    out = []
    for name in names or [*content, *[h for h in heads if h not in content]]:
        inner, base = heads.get(name), content.get(name)
        if inner is None:
            if base is not None or names:
                out.append(literal(base).alias(name))
        elif "" in inner:
            out.append(inner[""].alias(name))
        elif isinstance(base, list):
            out.append(F.array(_merged(base[0], inner)).alias(name))
        else:
            whole = _merged(base or {}, inner)
            out.append((whole if base else F.when(_some(inner), whole)).alias(name))
    return F.struct(*out)


def _some(fields: dict[str, Column]) -> Column:
    """Whether any of the values is there."""
    return reduce(Column.__or__, [v.isNotNull() for v in fields.values()])


@dataclass(frozen=True)
class _Slice:
    """A slice that is built once all items of its element are known, so that they have one shape."""

    content: dict
    paths: dict[str, Column]

    def column(self, names: list[str]) -> Column:
        built = _merged(self.content, self.paths, names)
        judged = {k: v for k, v in self.paths.items() if not k.startswith("_")}
        return F.when(_some(judged), built) if judged else built


class Resource:
    """Rules for one instance of a profile."""

    def __init__(self, profile: Profile, instance: Column | None = None):
        self.profile, self.instance = profile, instance
        self.values: dict[str, list[Column]] = {}
        self.nested: dict[str, dict[str, Column]] = {}
        self.arrays: set[int] = set()

    def assign(self, path: str, value: Column) -> "Resource":
        """One value for an element; again on a repeating element appends, else the last wins.

        A dotted path sets a child; an element's children make one item together, with what
        the profile fixes there.
        """
        head, _, rest = path.partition(".")
        if rest:
            self.profile.element(head)
            self.nested.setdefault(head, {})[rest] = value
            return self
        e = self.profile.element(path)
        if e.choices and path not in e.choices:
            if len(e.choices) != 1:
                raise ValueError(f"{path} needs a type: {', '.join(e.choices)}")
            path = e.choices[0]
        for other in e.choices:
            if other != path:
                self.values.pop(other, None)
        self.values.setdefault(path, []).append(value)
        return self

    def context(self, path: str, values: Column, body) -> "Resource":
        """One element for each value of an array; a missing array gives none."""
        return self.many(path, F.transform(F.filter(values, lambda v: v.isNotNull()), body))

    def many(self, path: str, items: Column) -> "Resource":
        """All items of an array for an element; an element that holds one keeps the last."""
        self.profile.element(path)
        self.values.setdefault(path, []).append(items)
        self.arrays.add(id(items))
        return self

    def slice(self, path: str, name: str, **fields: Column) -> "Resource":
        """A slice with its fixed content; given an only-null set of fields it is left out.

        Without fields the fixed content alone is instantiated.  ``__`` in a field's name
        stands for a dot.
        """
        key = f"{path}[{name}]"
        paths = {k if k.startswith("_") else k.replace("__", "."): v for k, v in fields.items()}
        paths = {self.profile.shorthand.get(f"{key}.{k}", k): v for k, v in paths.items()}
        self.values.setdefault(path, []).append(_Slice(self.profile.slices[key], paths))
        return self

    def extension(self, definition: Extension, value: Column) -> "Resource":
        """An extension by its definition, which need not be listed by the profile; nothing for a missing value."""
        built = F.struct(F.lit(definition.url).alias("url"), value.alias(definition.value))
        self.values.setdefault("extension", []).append(F.when(value.isNotNull(), built))
        return self

    def _column(self, name: str) -> Column | None:
        found = list(self.values.get(name, []))
        shape = list(dict.fromkeys(n for v in found if isinstance(v, _Slice) for n in _names(v.content, v.paths)))
        found = [v.column(shape) if isinstance(v, _Slice) else v for v in found]
        e, fixed = self.profile.element(name), self.profile.fixed.get(name)
        if name in self.nested:
            base = fixed[0] if isinstance(fixed, list) else fixed
            whole = _merged(base or {}, self.nested[name])
            found.append(whole if base else F.when(_some(self.nested[name]), whole))
        if not found:
            return None if fixed is None else literal(fixed)
        parts = [v if id(v) in self.arrays else listed(v) for v in found]
        if e.many:
            return appended(*parts)
        return last(F.concat(*[F.coalesce(p, F.array()) for p in parts])) if len(parts) > 1 or id(found[0]) in self.arrays else found[0]

    def checks(self) -> list[Column]:
        """Diagnostics of mandatory elements without a value, in definition order."""
        out = []
        for e in self.profile.elements:
            if e.required:
                found = [c for n in e.choices or (e.name,) if (c := self._column(n)) is not None]
                if e.many:
                    out.append(mandatory(found[0] if found else F.lit(None).cast("array<string>"), e.name, self.profile.name, many=True))
                else:
                    there = _some(dict(enumerate(found))) if found else F.lit(False)
                    out.append(mandatory(F.when(there, F.lit(1)), e.name, self.profile.name))
        return out

    def column(self) -> Column:
        """The resource as a struct in definition order; type, id and profile come first."""
        out = []
        if self.profile.resource:
            out.append(F.lit(self.profile.type).alias("resourceType"))
        if self.instance is not None:
            out.append(self.instance.cast("string").alias("id"))
        if self.profile.url:
            out.append(F.struct(F.array(F.lit(self.profile.url)).alias("profile")).alias("meta"))
        for e in self.profile.elements:
            for name in e.choices or (e.name,):
                if (c := self._column(name)) is not None:
                    out.append(c.alias(name))
                if f"_{name}" in self.values:
                    out.append(self.values[f"_{name}"][-1].alias(f"_{name}"))
        return F.struct(*out)

    def sibling(self, name: str, value: Column) -> "Resource":
        """The companion of a primitive element, such as ``_city``."""
        self.profile.element(name)
        self.values[f"_{name}"] = [value]
        return self


def updated(resource: Column, present: list[str], **fields: Column) -> Column:
    """A struct with fields replaced in place and new ones appended; ``present`` are its fields."""
    kept = [fields.pop(n, resource[n]).alias(n) for n in present]
    return F.struct(*kept, *[v.alias(k) for k, v in fields.items()])


def entry(resource: Column, method: Column | None = None, url: Column | None = None, schema: DataType | None = None) -> Column:
    """A Bundle entry: content-hash fullUrl, the resource, and the request if there is one.

    ``schema`` is the resource's, if it has fractional numbers (``scalar.json_text``).
    """
    parts = [content_link(resource, schema).alias("fullUrl"), resource.alias("resource")]
    if method is not None:
        parts.append(F.struct(method.alias("method"), url.alias("url")).alias("request"))
    return F.struct(*parts)


def bundle(entries: Column, kind: str = "transaction", instance: Column | None = None) -> Column:
    head = [F.lit("Bundle").alias("resourceType")]
    if instance is not None:
        head.append(instance.alias("id"))
    return F.struct(*head, F.lit(kind).alias("type"), entries.alias("entry"))
