"""Schema evolution: differences, what they break, and checks of the data that make them safe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..db import Database
from ..schema import Attr, Schema, validate


@dataclass(frozen=True)
class Edit:
    """A difference. ``needs`` names the check of the data that makes it safe; None where it always is."""

    collection: str
    attribute: str | None
    change: str
    needs: str | None = None
    enum: tuple = ()


def diff_schemas(old: Schema, new: Schema) -> list[Edit]:
    """Edits from one schema to another, attributes of records by dotted paths."""
    out: list[Edit] = []
    for name in sorted(old.collections.keys() | new.collections.keys()):
        a, b = old.collections.get(name), new.collections.get(name)
        if b is None:
            out.append(Edit(name, None, "collection removed", "collection empty"))
            continue
        if a is None:
            out.append(Edit(name, None, "collection added"))
            continue
        out += _attrs(name, "", a.attrs, b.attrs)
        for k in sorted(a.relationships.keys() | b.relationships.keys()):
            if a.relationships.get(k) != b.relationships.get(k):
                out.append(Edit(name, k, "relationship " + ("added" if k not in a.relationships else "removed" if k not in b.relationships else "changed")))
        if a.permissions != b.permissions:
            out.append(Edit(name, None, "permissions changed"))
    for role in sorted(old.roles.keys() | new.roles.keys()):
        if old.roles.get(role) != new.roles.get(role):
            out.append(Edit("", role, "role " + ("added" if role not in old.roles else "removed" if role not in new.roles else "changed")))
    return out


def _attrs(collection: str, prefix: str, old: dict[str, Attr], new: dict[str, Attr]) -> list[Edit]:
    out: list[Edit] = []
    for k in sorted(old.keys() | new.keys()):
        path, a, b = prefix + k, old.get(k), new.get(k)
        if a is None:
            safe = b.may_miss or b.default is not None
            out.append(Edit(collection, path, "attribute added" if safe else "required attribute added", None if safe else "collection empty"))
        elif b is None:
            out.append(Edit(collection, path, "attribute removed" if a.may_miss else "required attribute removed", "attribute empty"))
        elif a.kind != b.kind or a.of != b.of:
            out.append(Edit(collection, path, "type changed", "attribute empty"))
        else:
            if a.optional and not b.optional:
                out.append(Edit(collection, path, "optional removed", "attribute without null"))
            elif b.optional and not a.optional:
                out.append(Edit(collection, path, "optional added"))
            if a.nullable and not b.nullable:
                out.append(Edit(collection, path, "nullable removed", "attribute without null"))
            elif b.nullable and not a.nullable:
                out.append(Edit(collection, path, "nullable added"))
            if b.enum and (not a.enum or set(a.enum) - set(b.enum)):
                out.append(Edit(collection, path, "enum narrowed", "attribute satisfies enum", b.enum))
            elif a.enum != b.enum:
                out.append(Edit(collection, path, "enum widened"))
            if a.default != b.default:
                out.append(Edit(collection, path, "default changed"))
            out += _attrs(collection, path + ".", dict(a.fields), dict(b.fields))
    return out


def unsafe_rows(db: Database, edit: Edit):
    """The rows that an edit would leave in conflict with the schema."""
    rows = db.catalog.frame(edit.collection)
    if edit.needs == "collection empty":
        return rows
    c = F.col(edit.attribute)
    if edit.needs == "attribute empty":
        return rows.where(c.isNotNull())
    if edit.needs == "attribute without null":
        return rows.where(c.isNull())
    return rows.where(c.isNotNull() & ~c.isin(*edit.enum))


@dataclass(frozen=True)
class Outcome:
    code: str
    db: Database
    issues: tuple = ()


def override_schema(db: Database, new: Schema, fail_on_incompatible: bool = True) -> Outcome:
    """Take a new schema where it is valid and the data fits it.

    Codes: SUCCESS, SCHEMA_INVALID, EXISTING_DATA_MISMATCH, and
    SCHEMA_COMPATIBILITY_MISMATCH where an edit isn't compatible with old
    clients though the data fits and ``fail_on_incompatible`` is set.
    """
    from dataclasses import replace

    if issues := validate(new):
        return Outcome("SCHEMA_INVALID", db, tuple(issues))
    risky = [e for e in diff_schemas(db.schema, new) if e.needs]
    present = set(db.catalog.names)
    broken = [e for e in risky if e.collection in present and not unsafe_rows(db, e).isEmpty()]
    if broken:
        return Outcome("EXISTING_DATA_MISMATCH", db, tuple(broken))
    if risky and fail_on_incompatible:
        return Outcome("SCHEMA_COMPATIBILITY_MISMATCH", db, tuple(risky))
    return Outcome("SUCCESS", replace(db, schema=new), tuple(risky))
