"""Comment lines, property layouts and atom rows of the extended-XYZ text format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Fixed value: one key=value pair; the value may be quoted.
PAIR = r'([^\s="]+)=("[^"]*"|\S+)'


def info_keys(comment: Column) -> Column:
    """A3: keys in their written order."""
    return F.regexp_extract_all(comment, F.lit(PAIR), F.lit(1))


def parse_info(comment: Column) -> Column:
    """A3: comment line -> MAP of key to value, quotes removed; the last of equal keys wins."""
    keys = info_keys(comment)
    values = F.transform(
        F.regexp_extract_all(comment, F.lit(PAIR), F.lit(2)), lambda v: F.btrim(v, F.lit('"'))
    )
    return dedup_map(keys, values)


def dedup_map(keys: Column, values: Column) -> Column:
    """Map from parallel arrays; of equal keys the last one wins."""
    return F.aggregate(
        F.arrays_zip(keys.alias("k"), values.alias("v")),
        F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])
        ),
    )


def info_value(info: Column, key: str) -> Column:
    """Value of a key, ignoring the case of the key."""
    return F.get(
        F.map_values(F.map_filter(info, lambda k, _: F.lower(k) == key.lower())), F.lit(0)
    )


def floats(text: Column) -> Column:
    """Whitespace-separated numbers -> ARRAY<DOUBLE>; NULL if any token is not a number."""
    tokens = F.split(F.trim(text), r"\s+")
    values = F.transform(tokens, lambda t: t.try_cast("double"))
    return F.when(~F.exists(values, lambda v: v.isNull()), values)


def parse_lattice(text: Column) -> Column:
    """A5: nine row-major components; fewer is no lattice."""
    values = floats(text)
    return F.when(F.size(values) >= 9, F.slice(values, 1, 9))


def parse_pbc(text: Column) -> Column:
    """A5: three flags; absent or short means periodic on every axis."""
    tokens = F.split(F.trim(F.translate(text, ",", " ")), r"\s+")
    flags = F.transform(F.slice(tokens, 1, 3), lambda t: F.lower(t) == "t")
    yes = F.array(F.lit(True), F.lit(True), F.lit(True))
    return F.when(F.size(tokens) >= 3, flags).otherwise(yes)


def layout(properties: Column) -> Column:
    """A4: ``species:S:1:pos:R:3`` -> ARRAY<STRUCT<name, label, kind, width, start>> with 0-based starts.

    A string column always counts as one field. ``name`` is in lower case, ``label`` as written.
    """
    def of(parts: Column) -> Column:
        count = F.floor(F.size(parts) / 3).cast("int")
        cols = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda k: F.struct(
                F.lower(F.get(parts, k * 3)).alias("name"),
                F.get(parts, k * 3).alias("label"),
                F.get(parts, k * 3 + 1).alias("kind"),
                F.when(F.get(parts, k * 3 + 1) == "S", 1).otherwise(F.get(parts, k * 3 + 2).try_cast("int")).alias("width"),
            ),
        )
        return F.when(count > 0, let(cols, with_starts))

    def with_starts(cols: Column) -> Column:
        def start(i: Column) -> Column:
            return F.aggregate(F.slice(cols, 1, i), F.lit(0), lambda a, p: a + p["width"])

        return F.transform(cols, lambda c, i: c.withField("start", start(i)))

    return let(F.split(properties, ":"), of)


def n_fields(properties: Column) -> Column:
    """Number of fields an atom row must have."""
    return F.aggregate(layout(properties), F.lit(0), lambda a, c: a + c["width"])


def start_of(cols: Column, *names: str) -> Column:
    """0-based field where the first of the named columns of a layout starts, or NULL."""
    return F.get(F.filter(cols, lambda c: c["name"].isin(*names)), F.lit(0))["start"]


# Per-atom columns with fields of their own; the first of the two force names in a layout counts.
TYPED = ("species", "pos", "forces", "force")


def other_columns(cols: Column) -> Column:
    """The columns of a layout that have no field of their own, in written order.

    They are all but the first species, the first positions and the first forces (of either name).
    """
    one_name = F.transform(cols, lambda c: F.when(c["name"] == "force", "forces").otherwise(c["name"]))
    return let(
        one_name,
        lambda names: F.filter(cols, lambda c, i: ~c["name"].isin(*TYPED) | (F.array_position(names, F.get(names, i)) != i + 1)),
    )


def parse_atoms(lines: Column, properties: Column) -> Column:
    """A4: atom lines -> atoms array after a layout; ``more`` holds the text of the columns without a field."""

    def rows(o: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            def num(at: str, k: int) -> Column:
                return F.get(t, o[at] + k).try_cast("double")

            return F.struct(
                i.cast("int").alias("atom_idx"),
                F.get(t, o["species"]).alias("species"),
                *[num("pos", k).alias(c) for k, c in enumerate(("x", "y", "z"))],
                *[num("forces", k).alias(c) for k, c in enumerate(("fx", "fy", "fz"))],
                F.transform(o["others"], lambda c: F.array_join(F.slice(t, c["start"] + 1, c["width"]), " ")).alias("more"),
            )

        return F.transform(lines, lambda line, i: let(F.split(F.trim(line), r"\s+"), lambda t: one(t, i)))

    def offsets(cols: Column) -> Column:
        return F.struct(
            start_of(cols, "species").alias("species"), start_of(cols, "pos").alias("pos"),
            start_of(cols, "forces", "force").alias("forces"), other_columns(cols).alias("others"),
        )

    return let(let(layout(properties), offsets), rows)


def natural_key(text: Column) -> Column:
    """Sort key where runs of digits compare as numbers, whatever their length.

    A run is led by its length, three digits at a time: ``002`` before 12, ``999`` once for every 999 digits.
    """
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def one(p: Column) -> Column:
        run = F.regexp_replace(p, r"^0+(?=\d)", "")
        n = F.length(run)
        lead = F.concat(F.repeat(F.lit("999"), F.floor(n / 999).cast("int")), F.lpad((n % 999).cast("string"), 3, "0"))
        return F.when(p.rlike(r"^\d"), F.concat(lead, run)).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def render_value(v: Column) -> Column:
    """Quoted only where the value holds whitespace."""
    return F.when(v.rlike(r"\s"), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)


def render_info(info: Column, keys: Column) -> Column:
    """Comment line from a map, keys in the given order, absent ones left out."""
    present = F.filter(F.array_distinct(keys), lambda k: F.map_contains_key(info, k))
    pairs = F.transform(present, lambda k: F.concat(k, F.lit("="), render_value(F.element_at(info, k))))
    return F.array_join(pairs, " ")


def join_floats(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda v: v.cast("string")), " ")


# Layout letters of column types that users add to atoms.
_LETTERS = {"int": "I", "bigint": "I", "smallint": "I", "float": "R", "double": "R", "boolean": "L", "string": "S"}
_OWN_FIELDS = ("atom_idx", "species", "x", "y", "z", "fx", "fy", "fz", "more")


DEFAULT_LAYOUT = "species:S:1:pos:R:3"
_WITH_FORCES = (f"{DEFAULT_LAYOUT}:forces:R:3", f"{DEFAULT_LAYOUT}:force:R:3")


def render_layout(properties: Column, fields: dict[str, str], with_forces: Column) -> Column:
    """The layout to write: the one that was read, without forces that are gone, with forces and fields that are new.

    ``fields`` are the names and types of an atom's fields.
    """

    def written(cols: Column) -> Column:
        kept = F.filter(cols, lambda c: with_forces | ~c["name"].isin("forces", "force"))
        text = F.array_join(F.transform(kept, lambda c: F.concat_ws(":", c["label"], c["kind"], c["width"].cast("string"))), ":")
        forced = F.exists(cols, lambda c: c["name"].isin("forces", "force"))
        text = F.concat(text, F.when(with_forces & ~forced, ":forces:R:3").otherwise(""))
        for name, kind in fields.items():
            if name not in _OWN_FIELDS:
                there = F.array_contains(F.transform(cols, lambda c: c["name"]), name.lower())
                text = F.concat(text, F.when(there, "").otherwise(f":{name}:{_LETTERS.get(kind, 'S')}:1"))
        return text

    return let(layout(F.coalesce(properties, F.lit(DEFAULT_LAYOUT))), written)


def render_atoms(atoms: Column, properties: Column, written: Column, fields: dict[str, str]) -> Column:
    """Atom rows of the ``written`` layout, one line each; ``properties`` is the layout that ``more`` was read with."""
    own = {f.lower(): f for f in fields if f not in _OWN_FIELDS}
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])

    def rows(cols: Column) -> Column:
        def one(a: Column) -> Column:
            def value(c: Column) -> Column:
                out = F.when(c["name"] == "species", a["species"]).when(c["name"] == "pos", text(a["x"], a["y"], a["z"]))
                if "fx" in fields:
                    out = out.when(c["name"].isin("forces", "force"), text(a["fx"], a["fy"], a["fz"]))
                for name, field in own.items():
                    out = out.when(c["name"] == name, a[field].cast("string"))
                return out.otherwise(F.get(a["more"], c["at"])) if "more" in fields else out

            return F.array_join(F.transform(cols, value), " ")

        return F.array_join(F.transform(atoms, one), "\n")

    def placed(labels: Column) -> Column:
        at = lambda c: (F.array_position(labels, c["label"]) - 1).cast("int")
        return F.transform(layout(written), lambda c: F.struct(c["name"], at(c).alias("at")))

    def plain(*names: str) -> Column:
        return F.array_join(F.transform(atoms, lambda a: text(*[a[n] for n in names])), "\n")

    read = F.transform(other_columns(layout(F.coalesce(properties, F.lit(DEFAULT_LAYOUT)))), lambda c: c["label"])
    out = F.when(written == DEFAULT_LAYOUT, plain("species", "x", "y", "z"))
    if "fx" in fields:  # the two usual layouts need no look at the columns
        out = out.when(written.isin(*_WITH_FORCES), plain("species", "x", "y", "z", "fx", "fy", "fz"))
    return out.otherwise(let(let(read, placed), rows))
