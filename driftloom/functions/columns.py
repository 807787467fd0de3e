"""Column functions: all of them built-in expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAR_EDGES = (10, 50, 200, 1000)
STAR_LABELS = ("10-49", "50-199", "200-999", "1000+")
STRUCTURAL_TYPES = ("desc_only", "schema_add_only", "desc_and_schema_add", "schema_remove_only", "desc_and_schema_remove", "schema_mixed", "type_change")
LABELS = ("COSMETIC", "CLARIFICATION", "CAPABILITY_EXPANSION", "CAPABILITY_CONTRACTION", "BEHAVIORAL_DRIFT")

# Directory and file names that mark tests, and directories that are never read.
TEST_DIRECTORIES = ("test", "tests", "__tests__", "__mocks__", "examples", "example", "samples", "sample", "testapps", "templates", "template", "fixtures", "__fixtures__")
TEST_SUFFIXES = (".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", ".spec.js", ".test.mjs", ".spec.mjs", ".test.py", ".spec.py", "_test.go")
SKIPPED_DIRECTORIES = (".git", "node_modules", "dist", "build", "__pycache__", ".venv", "venv", "env", "vendor", "target")
# Phrases of doubt and of refusal.
DOUBT = (
    r"i('m| am) not sure|i('m| am) unclear|unclear|i don't know|i cannot determine|i'm unable|i need more|i would need|not enough information|"
    r"please (provide|clarify|confirm|let me know)|could you (provide|clarify|confirm|share|tell me)|what is the|what are the|can you (provide|tell|share|confirm)"
)
REFUSAL = (
    r"i (cannot|can't|won't|will not|am unable to|am not able to)|not possible|unable to (call|invoke|use|run|execute)|"
    r"cannot (call|invoke|use|run|execute|proceed)|should not|would not be appropriate"
)
# The keys of a schema's top level that stay.
SCHEMA_KEYS = ("type", "properties", "required", "description", "additionalProperties", "title", "default")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def canonical_url(c) -> Column:
    """Trimmed, without slashes at the end, https for the code host, ``owner/repo`` completed; blank is null."""
    u = F.regexp_replace(_stripped(_col(c)), "/+$", "")
    slashes = F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))
    return (
        F.when(u == "", None)
        .when(u.startswith("http://github.com"), F.concat(F.lit("https"), F.substring(u, 5, 1 << 30)))
        .when(~u.startswith("http") & (slashes == 1), F.concat(F.lit("https://github.com/"), u))
        .otherwise(u)
    )


def owner_repo(c) -> tuple[Column, Column]:
    """The first two parts of a URL's path; null if there are fewer."""
    path = F.regexp_replace(F.regexp_extract(_col(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "^/+|/+$", "")
    parts = F.split(path, "/")
    there = F.size(parts) >= 2
    return F.when(there, parts[0]), F.when(there, parts[1])


def slug(c, between: str = "__") -> Column:
    """The last two parts of a URL, joined."""
    parts = F.split(F.regexp_replace(_col(c), "/+$", ""), "/")
    return F.when(F.size(parts) >= 2, F.concat_ws(between, F.element_at(parts, -2), F.element_at(parts, -1)))


def short_name(c) -> Column:
    return F.element_at(F.split(_col(c), "github.com/"), -1)


def whole_number(c) -> Column:
    return F.expr(f"try_cast(try_cast({c} AS DOUBLE) AS BIGINT)") if isinstance(c, str) else c.try_cast("double").try_cast("bigint")


def star_bucket(c) -> Column:
    """Left-closed bins; below the first, above all or null: ``nan``."""
    c, out = _col(c), F.lit("nan")
    for lo, label in zip(STAR_EDGES, STAR_LABELS, strict=True):
        out = F.when(c >= lo, label).otherwise(out)
    return F.when(c.isNull(), "nan").otherwise(out)


def star_band(c) -> Column:
    c = F.coalesce(_col(c), F.lit(0))
    return F.when(c >= 10, ">=10").when(c >= 5, "5-9").when(c >= 1, "1-4").when(c == 0, "0").otherwise("<0")


def exclusion_reason(stars, archived, pushed, cutoff: Column) -> Column:
    stars, pushed = _col(stars), _col(pushed)
    reasons = F.concat_ws(
        "+",
        F.when(F.coalesce(stars < 10, F.lit(True)), "low_stars"),
        F.when(F.coalesce(_col(archived), F.lit(False)), "archived"),
        F.when(F.coalesce(pushed < cutoff, F.lit(True)), "stale"),
    )
    return F.coalesce(F.nullif(reasons, F.lit("")), F.lit("eligible"))


def structural_type(described, added, removed, types) -> Column:
    """What kind of change an event is, from its flag and the sizes of its lists."""
    d, a, r, t = (_col(x) for x in (described, added, removed, types))
    return (
        F.when(t > 0, "type_change")
        .when((a > 0) & (r > 0), "schema_mixed")
        .when(a > 0, F.when(d, "desc_and_schema_add").otherwise("schema_add_only"))
        .when(r > 0, F.when(d, "desc_and_schema_remove").otherwise("schema_remove_only"))
        .otherwise("desc_only")
    )


def property_types(schema) -> Column:
    """Property names of a JSON schema with their types: ``type``, else oneOf or anyOf, else object. A null schema has none.

    A property that is no JSON object is of type object; one that is JSON null has no type, but its name counts.
    """
    props = F.from_json(F.get_json_object(_col(schema), "$.properties"), "map<string,string>")
    props = F.coalesce(props, F.create_map().cast("map<string,string>"))

    def kind(k, v):
        named = F.get_json_object(v, "$.type")
        named = F.when(named.isin("", "[]", "{}", "false", "0"), None).otherwise(named)
        has = lambda x: F.get_json_object(v, f"$.{x}").isNotNull()
        return F.when(v.isNotNull(), F.coalesce(named, F.when(has("oneOf"), "oneOf").when(has("anyOf"), "anyOf").otherwise("object")))

    return F.transform_values(props, kind)


def fields_added(before, after) -> Column:
    return F.sort_array(F.array_except(F.map_keys(_col(after)), F.map_keys(_col(before))))


def fields_removed(before, after) -> Column:
    return fields_added(after, before)


def type_changes(before, after) -> Column:
    """(field, from_type, to_type) of the fields in both whose types differ."""
    b, a = _col(before), _col(after)
    both = F.sort_array(F.array_intersect(F.map_keys(b), F.map_keys(a)))
    changes = F.transform(both, lambda k: F.struct(k.alias("field"), F.element_at(b, k).alias("from_type"), F.element_at(a, k).alias("to_type")))
    return F.filter(changes, lambda x: ~x["from_type"].eqNullSafe(x["to_type"]))


def rendered_properties(types) -> Column:
    t = _col(types)
    parts = F.transform(F.map_entries(t), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("any"))))
    return F.when(F.coalesce(F.size(t), F.lit(0)) <= 0, "(none)").otherwise(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")))


def _listed(c: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))


def change_summary(described, added, removed, types) -> Column:
    d, a, r, t = (_col(x) for x in (described, added, removed, types))
    moved = F.transform(t, lambda x: F.concat(x["field"], F.lit(": "), F.coalesce(x["from_type"], F.lit("?")), F.lit("→"), F.coalesce(x["to_type"], F.lit("?"))))
    return F.concat_ws(
        "; ",
        F.when(d, "description changed"),
        F.when(F.size(a) > 0, F.concat(F.lit("fields added: "), _listed(a))),
        F.when(F.size(r) > 0, F.concat(F.lit("fields removed: "), _listed(r))),
        F.when(F.size(t) > 0, F.concat(F.lit("type changes: "), _listed(moved))),
    )


def prompt(template: str, **values) -> Column:
    """``template`` with its {names} filled in by columns; a null value is shown as (none)."""
    names = sorted(values, key=template.index)
    form = template.replace("%", "%%")
    for n in names:
        form = form.replace("{%s}" % n, "%s", 1)  # noqa: UP031
    return F.format_string(form, *[F.coalesce(_stripped(_col(values[n]).cast("string")), F.lit("(none)")) for n in names])


def jaccard(a, b) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    a, b = _col(a), _col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def rename_tier(schema_similarity, text_similarity) -> Column:
    s, d = _col(schema_similarity), _col(text_similarity)
    return F.when((s >= 1) & (d >= 1), "Perfect").when((s >= 0.8) & (d >= 0.5), "High").when((s >= 0.5) & (d >= 0.3), "Medium")


def word_set(c) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"\s+"), lambda w: w != ""))


def expresses_doubt(c) -> Column:
    return F.coalesce(_col(c).rlike(rf"(?i)\b({DOUBT})\b"), F.lit(False))


def expresses_refusal(c) -> Column:
    return F.coalesce(_col(c).rlike(rf"(?i)\b({REFUSAL})\b"), F.lit(False))


def is_test_path(c) -> Column:
    """A directory on the way is a test's by its exact name, or the file's name ends like a test's."""
    parts = F.split(_col(c), "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.lower(F.element_at(parts, -1))
    ends = F.lit(False)
    for s in TEST_SUFFIXES:
        ends = ends | name.endswith(s)
    return F.arrays_overlap(above, F.array(*map(F.lit, TEST_DIRECTORIES))) | ends


def is_skipped_path(c) -> Column:
    """Some part of the path is a directory that is never read. The path is relative to the repository."""
    return F.arrays_overlap(F.split(_col(c), "/"), F.array(*map(F.lit, SKIPPED_DIRECTORIES)))


def preview(c, n: int = 80) -> Column:
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def reply_label(c, labels=LABELS) -> Column:
    """The label of a model's JSON reply, code fence or not; PARSE_ERROR if it is none of ``labels``."""
    text = F.regexp_replace(F.regexp_replace(_stripped(_col(c)), r"^`+(?:json)?\s*", ""), r"\s*`+$", "")
    label = F.upper(F.trim(F.coalesce(F.get_json_object(text, "$.label"), F.lit(""))))
    return F.when(label.isin(*labels), label).otherwise("PARSE_ERROR")


def clean_label(c) -> Column:
    return F.upper(F.trim(_col(c)))


def sanitised_schema(c) -> Column:
    """A schema's top-level keys that stay, as JSON; without any, an object schema without properties."""
    v = F.try_parse_json(_col(c))
    parts = [F.to_json(F.try_variant_get(v, f"$.{k}", "variant")) for k in SCHEMA_KEYS]
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), p) for k, p in zip(SCHEMA_KEYS, parts, strict=True)])
    return F.when(body == "", '{"type":"object","properties":{}}').otherwise(F.concat(F.lit("{"), body, F.lit("}")))


#: A JSON string, which the steps below pass over.
_STRING = r'"(?:[^"\\]|\\.)*"'


def relaxed_json(c) -> Column:
    """JSON of an object literal with commas at ends, single quotes or bare keys, as VARIANT; null if it is none. What stands in strings stays."""
    double = F.regexp_replace(_col(c), r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'', '"$1$2"')
    closed = F.regexp_replace(double, f"({_STRING})|,(?=\\s*[}}\\]])", "$1")
    # A mark stands for the quotes of bare keys; a string that was passed over has two marks and nothing between them.
    keyed = F.regexp_replace(closed, f"({_STRING})|([{{,]\\s*)([A-Za-z_]\\w*)(?=\\s*:)", "$1$2\u0001$3\u0001")
    return F.try_parse_json(F.replace(F.replace(keyed, F.lit("\u0001\u0001"), F.lit("")), F.lit("\u0001"), F.lit('"')))


def matches(query: str, *columns) -> Column:
    """Free-text search: a regular expression over lower-cased columns; null does not match."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(_col(c)).rlike(query.lower()), F.lit(False))
    return hit


def joined(c, between: str = ", ") -> Column:
    return F.array_join(F.coalesce(_col(c), F.array().cast("array<string>")), between)


def digest(*keys, seed: int = 42) -> Column:
    """A reproducible random order: md5 of the keys' text and the seed."""
    return F.md5(F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def replacement_reason(cloned, signals, tools) -> Column:
    return F.when(~_col(cloned), "clone_failed").when(_col(tools) > 0, None).when(_col(signals), "zero_tools_found").otherwise("not_a_server")


def replacement(cloned, tools, hosted, curated, signals) -> Column:
    """A struct (reason, note): why a repository has to be replaced, null if it need not. Nulls count as false, and as no tools.

    Hosted servers and curated lists are told from others without tools by their note, whatever signals they have.
    """
    is_ = lambda c: F.coalesce(_col(c), F.lit(False))
    none = is_(cloned) & (F.coalesce(_col(tools), F.lit(0)) <= 0)
    note = F.when(none & is_(hosted), "remote_hosted_server").when(none & is_(curated), "curator_list")
    reason = F.when(note.isNotNull(), "not_a_server").otherwise(replacement_reason(is_(cloned), is_(signals), F.coalesce(_col(tools), F.lit(0))))
    return F.struct(reason.alias("reason"), note.alias("note"))


def timestamp_or_null(c) -> Column:
    """A text's time, in UTC where it names no zone (the session's zone is UTC); null if it is none."""
    return F.try_to_timestamp(_stripped(_col(c)))


def months_before(as_of, months: int) -> Column:
    """The same day so many months earlier, or the month's last one. ``as_of`` is a parameter, so that a run can be repeated."""
    t = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return (F.add_months(t.cast("date"), -months).cast("timestamp_ntz") + (t - F.date_trunc("day", t))).cast("timestamp_ntz")


def rendered_required(schema) -> Column:
    """A schema's required names as a list, ``['a', 'b']``; ``[]`` without any."""
    names = F.from_json(F.get_json_object(_col(schema), "$.required"), "array<string>")
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, _listed(names)).otherwise("[]")


def category_order(c, values: list[str]) -> Column:
    """A sort key for an order of one's own: the value's place in ``values``, others after them, null last."""
    place = F.array_position(F.array(*map(F.lit, values)), _col(c))
    return F.when(_col(c).isNull(), len(values) + 2).when(place > 0, place).otherwise(len(values) + 1)


def coordinate_risk(moved, before, after, path) -> Column:
    """An entity may have been mistaken for another: its file moved between two empty schemas, or it is a numbered chapter's."""
    return (_col(moved) & (F.size(_col(before)) == 0) & (F.size(_col(after)) == 0)) | _col(path).rlike(r"/\d{2,3}/")
