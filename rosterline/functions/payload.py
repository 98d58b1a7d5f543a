"""Provider payload handling.

A payload is parsed once, into a VARIANT column; paths and the items of a response are
read from that binary form by Catalyst's variant expressions, so the text is not parsed
again for each path and no Python touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.normalize import clean_phone, strip_ws

__all__ = [
    "json_path", "as_variant", "parse_payload", "explode_response", "apply_field_map",
    "profile_to_contact", "first_nested_phone", "contact_phone", "PROFILE_SCHEMA",
]

TOLERANT = {"allowUnquotedControlChars": "true"}

PROFILE_SCHEMA = ("struct<firstName:string,lastName:string,name:string,headline:string,"
                  "linkedinUrl:string,location:struct<linkedinText:string>,"
                  "currentPositions:array<struct<title:string,companyName:string>>>")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_path(path: str) -> str:
    """Dot path with ``[i]`` / ``[]`` (all items) → JSONPath understood by Spark."""
    p = path.replace("[i]", "[*]").replace("[]", "[*]")
    return "$" + ("" if p.startswith("[") else ".") + p


def parse_payload(c, schema: str) -> Column:
    """Parse JSON that may carry raw control characters."""
    return F.from_json(_c(c), schema, TOLERANT)


def as_variant(c) -> Column:
    """JSON text, raw control characters allowed, as VARIANT; broken text is NULL."""
    return F.from_json(_c(c), "variant", TOLERANT)


def _parsed(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with the payload as VARIANT in ``_v``, parsed here unless it already is one."""
    is_variant = df.schema[payload].dataType.typeName() == "variant"
    return df.withColumn("_v", F.col(payload) if is_variant else as_variant(payload))


def explode_response(df: DataFrame, payload: str, list_path: str,
                     item_col: str = "item", pos_col: str = "pos") -> DataFrame:
    """S3: one output row per element at ``list_path``; a missing list gives no rows.

    ``item`` is the element as VARIANT (``to_json`` gives its text), for ``apply_field_map`` or ``try_variant_get``.
    """
    items = F.try_variant_get("_v", json_path(list_path), "array<variant>")
    return _parsed(df, payload).select(*df.columns, F.posexplode(items).alias(pos_col, item_col))


def apply_field_map(df: DataFrame, payload: str, mapping: dict[str, str], provider: str,
                    canonical: list[str] | None = None) -> DataFrame:
    """Provider JSON paths → canonical columns; ``payload`` is JSON text or VARIANT.

    ``mapping`` is {json path: canonical target}.  Targets ``intel.x`` and
    ``provider_ids.p`` are gathered into MAP columns; canonical fields that are
    not mapped come out NULL; ``source`` is the provider name.  An ``[]`` path gives all its values as a JSON array.
    """
    def value(path: str) -> Column:
        at = json_path(path)
        if "[*]" in at:      # variants have no wildcard: only such a path is read from text
            return F.get_json_object(F.to_json("_v"), at)
        return F.try_variant_get("_v", at, "string")

    flat: dict[str, Column] = {}
    nested: dict[str, list[tuple[str, Column]]] = {}
    for path, target in mapping.items():
        v = value(path)
        if "." in target:
            root, key = target.split(".", 1)
            nested.setdefault(root, []).append((key, v))
        else:
            flat[target] = v
    out = [F.col(c) for c in df.columns]
    for name in (canonical or []):
        if name not in flat and name not in nested and name != "source":
            out.append(F.lit(None).cast("string").alias(name))
    out += [v.alias(k) for k, v in flat.items()]
    for root, kvs in nested.items():
        m = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in kvs]), F.array(*[v for _, v in kvs]))
        out.append(F.map_filter(m, lambda k, v: v.isNotNull()).alias(root))
    out.append(F.lit(provider).alias("source"))
    return _parsed(df, payload).select(*out)


def profile_to_contact(df: DataFrame, payload: str) -> DataFrame:
    """Profile item → contact fields (first current position, headline fallback)."""
    prof = F.from_json(F.col(payload), PROFILE_SCHEMA, TOLERANT)
    pos0 = F.try_element_at(prof["currentPositions"], F.lit(1))
    fn, ln = prof["firstName"], prof["lastName"]
    joined = F.concat_ws(" ", F.nullif(fn, F.lit("")), F.nullif(ln, F.lit("")))
    return df.select(
        "*",
        fn.alias("first_name"), ln.alias("last_name"),
        F.coalesce(F.nullif(joined, F.lit("")), prof["name"]).alias("full_name"),
        F.coalesce(F.nullif(pos0["title"], F.lit("")), prof["headline"]).alias("title"),
        pos0["companyName"].alias("company_name"),
        prof["linkedinUrl"].alias("linkedin_url"),
        prof["location"]["linkedinText"].alias("location"),
        F.lit("apify").alias("source"),
    )


def first_nested_phone(c) -> Column:
    """First usable phone in ``[["+1 …"], …]``; a plain string row also counts.

    ``c`` is the JSON text of the ``data`` array.
    """
    rows = F.from_json(_c(c), "array<string>", TOLERANT)
    cand = F.transform(rows, lambda r: F.when(
        r.startswith("["), clean_phone(F.get_json_object(r, "$[0]"))).otherwise(clean_phone(r)))
    return F.try_element_at(F.filter(cand, lambda x: x.isNotNull()), F.lit(1))


def contact_phone(c) -> Column:
    """Phone from ``most_probable_phone`` when it is an object, else ``phones[0]``.

    ``c`` is the JSON text of the contact-info object.  A present but blank
    object yields NULL with no fallback.
    """
    mpp = F.get_json_object(_c(c), "$.most_probable_phone")
    is_obj = F.coalesce(strip_ws(mpp).startswith("{"), F.lit(False))
    own = F.nullif(F.replace(F.coalesce(F.get_json_object(mpp, "$.number"), F.lit("")),
                             F.lit(" "), F.lit("")), F.lit(""))
    first = F.nullif(F.replace(F.coalesce(F.get_json_object(_c(c), "$.phones[0].number"), F.lit("")),
                               F.lit(" "), F.lit("")), F.lit(""))
    return F.when(is_obj, own).otherwise(first)

