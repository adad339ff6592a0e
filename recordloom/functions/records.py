"""Functions over one record: strict parsing, type names, key renaming, flattening.

A record is a VARIANT object. All functions are row-wise, so a table of records is
parsed, renamed and flattened in the scan stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.columns import as_column, let, literal, over
from recordloom.functions.text import first_json_object, single_to_double_quotes, strip_backslashes

# Names of the seven value types a record can hold.
TYPE_NAMES = ("str", "int", "float", "bool", "list", "dict", "NoneType")

# Levels that records usually have, and the deepest nesting the JSON parser accepts.
USUAL_DEPTH = 5
PARSER_DEPTH = 1000
# Levels below the keys of a record that are opened by nested expressions, without a list of nodes in between.
NESTED_DEPTH = 3
WHOLE_FLOAT_DIGITS = 18  # decimals without a fraction of up to so many digits are floats, longer ones integers

DIRECTIONS = ("schema_to_json", "json_to_schema")


def parse_record(text: Column | str) -> Column:
    """Parse JSON text strictly into a VARIANT; null when the text is not exactly one JSON value.

    The parser stops after the first value and ignores what follows. So the text is parsed as
    the first item of a list whose second item is the MD5 sum of the text: any other value,
    bracket or leftover in the text moves that item from its place or ends the list before it.
    """
    return over(lambda text: parse_sql(text), text=text)


def parse_sql(text: str) -> str:
    listed = f"try_parse_json(concat('[', {text}, ',\"', mark, '\"]'))"
    first = "if(try_variant_get(listed, '$[1]', 'string') = mark, try_variant_get(listed, '$[0]', 'variant'), NULL)"
    return let(f"md5({text})", "mark", let(listed, "listed", first))


def parse_output(
    text: Column | str, mapping: dict[str, str] | None = None, direction: str = "json_to_schema"
) -> Column:
    """Record in a model output: parsed as is, else from the first object after quote repair.

    With a `mapping` its keys are renamed; values that are not records, and empty records,
    then give null.
    """
    text = as_column(text)
    fallback = strip_backslashes(first_json_object(single_to_double_quotes(text)))
    parsed = F.coalesce(parse_record(text), parse_record(fallback))
    if not mapping:
        return parsed
    return F.to_variant_object(rename_keys(as_map(parsed), mapping, direction))


def as_map(value: Column | str) -> Column:
    """MAP<STRING,VARIANT> of an object, keys in alphabetical order; null for other values."""
    return F.try_variant_get(as_column(value), "$", "map<string,variant>")


def as_list(value: Column | str) -> Column:
    return F.try_variant_get(as_column(value), "$", "array<variant>")


def type_name(value: Column | str) -> Column:
    """Type name of a value, one of `TYPE_NAMES`; null for a missing value."""
    return over(lambda value: type_name_sql(value), value=value)


def type_name_sql(value: str) -> str:
    return let(f"schema_of_variant({value})", "s", name_of_schema_sql("s"))


def name_of_schema_sql(schema: str) -> str:
    # DECIMAL(n,0): one digit, or two of at most the limit
    whole = f"length({schema}) = 12 OR substring({schema}, 9, 2) <= '{WHOLE_FLOAT_DIGITS}'"
    return f"""CASE
        WHEN {schema} = 'STRING' THEN 'str'
        WHEN {schema} = 'BIGINT' THEN 'int'
        WHEN {schema} = 'BOOLEAN' THEN 'bool'
        WHEN {schema} = 'VOID' THEN 'NoneType'
        WHEN startswith({schema}, 'ARRAY') THEN 'list'
        WHEN startswith({schema}, 'OBJECT') THEN 'dict'
        WHEN startswith({schema}, 'DECIMAL') AND (NOT endswith({schema}, ',0)') OR {whole}) THEN 'float'
        WHEN startswith({schema}, 'DECIMAL') THEN 'int'
        WHEN {schema} IN ('DOUBLE', 'FLOAT') THEN 'float' END"""


def value_text_sql(value: str, name: str, scalar: bool = False) -> str:
    """Text of a value as string formatting prints it; lists and dicts, which no `scalar` is, as JSON."""
    nested = "" if scalar else f"WHEN {name} IN ('list', 'dict') THEN {json_text_sql(value)}"
    return f"""CASE
        WHEN {name} = 'str' THEN try_variant_get({value}, '$', 'string')
        {nested}
        WHEN {name} = 'bool' THEN initcap(to_json({value}))
        WHEN {name} = 'NoneType' THEN 'None'
        WHEN {name} = 'float' THEN {float_text_sql(f"try_variant_get({value}, '$', 'double')")}
        ELSE to_json({value}) END"""


def float_text_sql(number: str) -> str:
    """Text of a double as string formatting prints it: plain from 1e-4 to below 1e16, else with an exponent.

    The cast gives the same digits, but writes an exponent from 1e7 on and below 1e-3.
    """
    digits = "regexp_replace(replace(replace(x.m, '-', ''), '.', ''), '(?<=.)0+$', '')"
    parts = f"struct(if(startswith(x.m, '-'), '-', '') AS sign, {digits} AS d, x.e AS e)"
    plain = "concat(p.sign, rpad(substring(p.d, 1, p.e + 1), p.e + 1, '0'), '.', if(length(p.d) > p.e + 1, substring(p.d, p.e + 2), '0'))"
    exponent = "concat('e', if(p.e < 0, '-', '+'), lpad(abs(p.e), greatest(length(abs(p.e)), 2), '0'))"
    scientific = f"concat(p.sign, substring(p.d, 1, 1), if(length(p.d) > 1, concat('.', substring(p.d, 2)), ''), {exponent})"
    chosen = f"CASE WHEN p.e BETWEEN 0 AND 15 THEN {plain} WHEN p.e = -4 THEN concat(p.sign, '0.000', p.d) ELSE {scientific} END"
    split = "struct(substring_index(t, 'E', 1) AS m, CAST(substring_index(t, 'E', -1) AS INT) AS e)"
    rewritten = let(split, "x", let(parts, "p", chosen))
    return let(f"CAST({number} AS STRING)", "t", f"if(contains(t, 'E'), {rewritten}, t)")


def json_text(value: Column | str, item_sep: str = ",", key_sep: str = ":") -> Column:
    """JSON text with sorted keys at every level, however deep.

    Floats are written as string formatting prints them (``900.0``, ``1e+300``). A value is taken apart level by level into an ordered
    array of pieces, finished text and values still to be opened, until only text is left to be joined.
    """

    def written(value: str) -> str:
        level_by_level = json_text_sql(value, item_sep, key_sep)
        text = _written_sql(value, item_sep, key_sep, NESTED_DEPTH)
        return f"if({value} IS NULL, NULL, {let(text, 'written', f'if(contains(written, char(0)), {level_by_level}, written)')})"

    return over(written, value=value)


def json_text_sql(value: str, item_sep: str = ",", key_sep: str = ":") -> str:
    return f"if({value} IS NULL, NULL, {_joined_sql(f'array({_piece_sql(value)})', item_sep, key_sep)})"


def _written_sql(value: str, item_sep: str, key_sep: str, depth: int) -> str:
    """JSON text of a value, written by nested expressions over `depth` levels; U+0000, never in JSON text, for what lies deeper."""
    child, s = f"c{depth}", f"s{depth}"
    below = "char(0)"
    if depth:
        members = f"transform(map_entries({map_sql(value)}), e -> struct(concat({_key_sql('e.key')}, {literal(key_sep)}) AS key, e.value AS value))"
        items = f"transform({list_sql(value)}, x -> struct('' AS key, x AS value))"
        text = f"concat({child}.key, {_written_sql(f'{child}.value', item_sep, key_sep, depth - 1)})"
        joined = f"array_join(transform(coalesce({members}, {items}), {child} -> {text}), {literal(item_sep)})"
        below = let(joined, "joined", f"if(startswith({s}, 'OBJECT'), concat('{{', joined, '}}'), concat('[', joined, ']'))")
    text = f"if(startswith({s}, 'OBJECT') OR startswith({s}, 'ARRAY'), {below}, {_scalar_sql(value, s)})"
    return let(f"schema_of_variant({value})", s, text)


def map_json_text(record: Column, item_sep: str = ",", key_sep: str = ":") -> Column:
    """JSON text of a MAP<STRING,VARIANT>, in the order of the map; what lies in it as by `json_text`."""
    return over(
        lambda record: f"if({record} IS NULL, NULL, {_joined_sql(_object_sql(record, item_sep, key_sep), item_sep, key_sep)})",
        record=record,
    )


def _joined_sql(pieces: str, item_sep: str, key_sep: str) -> str:
    opened = f"""if(n.done, array(n), coalesce(
        {_object_sql(map_sql("n.value"), item_sep, key_sep)}, {_array_sql(list_sql("n.value"), item_sep)}))"""
    return f"array_join(transform({expand_sql(pieces, opened)}, n -> n.text), '')"


def _text_piece_sql(text: str) -> str:
    return f"struct({text} AS text, CAST(NULL AS VARIANT) AS value, true AS done)"


def _piece_sql(value: str) -> str:
    """A value as a piece: finished text unless it is an object or a list."""
    nested = "startswith(s, 'OBJECT') OR startswith(s, 'ARRAY')"
    piece = f"if({nested}, struct('' AS text, {value} AS value, false AS done), {_text_piece_sql(_scalar_sql(value, 's'))})"
    return let(f"schema_of_variant({value})", "s", piece)


def _scalar_sql(value: str, schema: str) -> str:
    number = float_text_sql(f"try_variant_get({value}, '$', 'double')")
    return f"if({name_of_schema_sql(schema)} = 'float', {number}, to_json({value}))"


def _key_sql(key: str) -> str:
    """A key as a JSON string. In a list it has quotes at both ends, so only the brackets around it are trimmed."""
    return f"if({key} RLIKE '^[A-Za-z0-9_ ]+\\\\z', concat('\"', {key}, '\"'), trim(BOTH '[]' FROM to_json(array({key}))))"


def _object_sql(members: str, item_sep: str, key_sep: str) -> str:
    """Pieces of a map, null for null: a brace, its entries, a brace."""
    before = f"concat(if(i > 0, {literal(item_sep)}, ''), {_key_sql('e.key')}, {literal(key_sep)})"
    entries = f"transform(map_entries({members}), (e, i) -> array({_text_piece_sql(before)}, {_piece_sql('e.value')}))"
    return f"concat(array({_text_piece_sql(literal('{'))}), flatten({entries}), array({_text_piece_sql(literal('}'))}))"


def _array_sql(items: str, item_sep: str) -> str:
    """Pieces of a list, null for null."""
    separated = f"array({_text_piece_sql(f"if(i > 0, {literal(item_sep)}, '')")}, {_piece_sql('item')})"
    entries = f"transform({items}, (item, i) -> {separated})"
    return f"concat(array({_text_piece_sql(literal('['))}), flatten({entries}), array({_text_piece_sql(literal(']'))}))"


def map_sql(value: str) -> str:
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def list_sql(value: str) -> str:
    return f"try_variant_get({value}, '$', 'array<variant>')"


def rename_keys(record: Column, mapping: dict[str, str], direction: str = "schema_to_json") -> Column:
    """Rename keys of a MAP<STRING,VARIANT> by a small mapping.

    The renames are applied in the order of the mapping, so chains work and a later rename
    replaces an entry that already has the new name; keys that are absent are skipped. A
    null or empty record gives null. The result has its keys in alphabetical order.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
    return over(lambda record: rename_sql(record, mapping, direction), record=record)


def rename_sql(record: str, mapping: dict[str, str], direction: str = "schema_to_json") -> str:
    if not mapping:
        return f"if(size({record}) > 0, {record}, NULL)"
    flip = direction == "json_to_schema"
    steps = ", ".join(
        f"struct({literal(new if flip else old)} AS old, {literal(old if flip else new)} AS new)"
        for old, new in mapping.items()
    )
    rest = "map_filter(m, (k, v) -> k != step.old AND k != step.new)"
    rename = f"if(map_contains_key(m, step.old), map_concat({rest}, map(step.new, element_at(m, step.old))), m)"
    ordered = "map_from_arrays(sort_array(map_keys(r)), transform(sort_array(map_keys(r)), k -> element_at(r, k)))"
    renamed = f"aggregate(array({steps}), {record}, (m, step) -> {rename})"
    return f"if(size({record}) > 0, {let(renamed, 'r', ordered)}, NULL)"


def schema_map(record: Column) -> Column:
    """MAP of key to type name for a MAP<STRING,VARIANT>."""
    return over(lambda record: schema_map_sql(record), record=record)


def schema_map_sql(record: str) -> str:
    return f"transform_values({record}, (k, v) -> {type_name_sql('v')})"


def schema_text(record: Column) -> Column:
    """Schema of a record as JSON text, ``{key: type name}``."""
    return F.to_json(schema_map(record))


# --- flattening -----------------------------------------------------------------


def flatten_record(record: Column | str) -> Column:
    """Leaves of a nested record as ARRAY<STRUCT<path, type, text>>, depth first.

    A key below a key is joined by a blank, a list element is ``name[i]``. Objects in lists
    are flattened, lists in lists are leaves, empty objects and lists vanish, null stays.
    """
    return over(lambda record: flatten_sql(record), record=record)


def flatten_sql(record: str) -> str:
    nodes = f"transform(map_entries({map_sql(record)}), e -> {_node_sql('e.key', 'e.value')})"
    below = _opened_sql("e0.value", "e0.key", False, NESTED_DEPTH)
    return _leaves_sql(f"flatten(transform(map_entries({map_sql(record)}), e0 -> {below}))", nodes)


def leaves_below_sql(value: str, path: str, in_list: str) -> str:
    """Leaves of what lies at a path, inside a list or not, in the form of `flatten_record`."""
    return _leaves_sql(_opened_sql(value, path, in_list, NESTED_DEPTH + 1), f"array({_node_sql(path, value, in_list)})")


def _leaves_sql(opened: str, nodes: str) -> str:
    """Leaves out of what was opened by nested expressions or, if that left anything whole, out of nodes level by level."""
    level_by_level = f"transform({expand_sql(nodes)}, n -> {leaf_sql('n.value', 'n.path')})"
    leaves = f"transform({opened}, n -> {leaf_sql('n.value', 'n.path', scalar=True)})"
    return let(leaves, "leaves", f"if(exists(leaves, x -> x.type IN ('list', 'dict')), {level_by_level}, leaves)")


def _opened_sql(value: str, path: str, in_list: bool | str, depth: int) -> str:
    """What lies at a path as ARRAY<STRUCT<path, value>>, opened by nested expressions over `depth` levels.

    Lists inside lists and what lies deeper stay whole. `in_list` is known or SQL text.
    """
    entry, item, i, at = (f"{name}{depth}" for name in ("e", "x", "i", "p"))
    if depth == 0:
        return f"array(struct({path} AS path, {value} AS value))"
    whole = f"array(struct({at} AS path, {value} AS value))"
    key = f"if({at} = '', {entry}.key, concat({at}, ' ', {entry}.key))"
    members = f"flatten(transform(map_entries({map_sql(value)}), {entry} -> {_opened_sql(f'{entry}.value', key, False, depth - 1)}))"
    below = _opened_sql(item, f"concat({at}, '[', {i}, ']')", True, depth - 1)
    items = f"flatten(transform({list_sql(value)}, ({item}, {i}) -> {below})), "
    if in_list:
        items = "" if in_list is True else f"CASE WHEN NOT {in_list} THEN {items.removesuffix(', ')} END, "
    return let(path, at, f"coalesce({members}, {items}{whole})")


def expand_sql(nodes: str, expanded: str | None = None) -> str:
    """Take nodes apart level by level until only leaves are left. `expanded`: the nodes that replace a node `n`.

    A fold over level numbers stands for the loop. It does nothing once all nodes are
    leaves; levels beyond the usual ones are only counted for the records that have them.
    """
    state = "struct(nodes AS nodes, exists(nodes, n -> NOT n.done) AS open)"
    level = let(f"flatten(transform(acc.nodes, n -> {expanded or _EXPANDED_NODE}))", "nodes", state)

    def fold(start: str, first: int, last: int) -> str:
        return f"aggregate(sequence({first}, {last}), {start}, (acc, level) -> if(acc.open, {level}, acc))"

    usual = fold(let(nodes, "nodes", state), 1, USUAL_DEPTH)
    rest = f"if(usual.open, {fold('usual', USUAL_DEPTH + 1, PARSER_DEPTH)}, usual).nodes"
    return let(usual, "usual", rest)


def _node_sql(path: str, value: str, in_list: bool | str = False, done: bool = False) -> str:
    return f"struct({path} AS path, {value} AS value, {in_list} AS in_list, {done} AS done)"


_CHILD_PATH = "if(n.path = '', e.key, concat(n.path, ' ', e.key))"
_MEMBERS = (
    f"transform(map_entries({map_sql('n.value')}), e -> {_node_sql(_CHILD_PATH, 'e.value')})"
)
_ITEMS = (
    f"transform({list_sql('n.value')}, "
    f"(item, i) -> {_node_sql("concat(n.path, '[', i, ']')", 'item', in_list=True)})"
)
_EXPANDED_NODE = f"""CASE WHEN n.done THEN array(n) ELSE coalesce(
    {_MEMBERS},
    CASE WHEN NOT n.in_list THEN {_ITEMS} END,
    array(struct(n.path AS path, n.value AS value, n.in_list AS in_list, true AS done))) END"""


def leaf_sql(value: str, path: str, scalar: bool = False) -> str:
    """A finished node as STRUCT<path, type, text>."""
    leaf = f"struct({path} AS path, name AS type, {value_text_sql(value, 'name', scalar)} AS text)"
    return let(type_name_sql(value), "name", leaf)


def top_level_fields(record: Column | str) -> Column:
    """Keys of a record with their values unflattened, in the shape of `flatten_record`."""
    return over(lambda record: top_level_sql(record), record=record)


def top_level_sql(record: str) -> str:
    return f"transform(map_entries({map_sql(record)}), e -> {leaf_sql('e.value', 'e.key')})"


# --- schema of many records -----------------------------------------------------


def schema_nodes(record: Column | str) -> Column:
    """Every value of a record, containers included, as ARRAY<STRUCT<parent, path, in_list, type>>.

    Paths are those of `flatten_record`, but items of a list share the path ``name[]``, lists in lists are opened too and
    the record itself has the path ``''``.
    """
    return over(lambda record: schema_nodes_sql(record), record=record)


def schema_nodes_sql(record: str) -> str:
    def node(parent: str, path: str, in_list: str, value: str) -> str:
        return f"struct({parent} AS parent, {path} AS path, {in_list} AS in_list, CAST(NULL AS STRING) AS type, {value} AS value, false AS done)"

    def own(name: str) -> str:
        # a finished node needs its value no more; only leaves are asked for their type
        return f"array(struct(n.parent AS parent, n.path AS path, n.in_list AS in_list, {name} AS type, CAST(NULL AS VARIANT) AS value, true AS done))"

    members = f"transform(map_entries({map_sql('n.value')}), e -> {node('n.path', _CHILD_PATH, 'false', 'e.value')})"
    items = f"transform({list_sql('n.value')}, item -> {node('n.path', "concat(n.path, '[]')", 'true', 'item')})"
    expanded = f"""if(n.done, array(n), coalesce(
        concat({own("'dict'")}, {members}), concat({own("'list'")}, {items}), {own(type_name_sql('n.value'))}))"""
    root = f"array({node('CAST(NULL AS STRING)', "''", 'false', record)})"
    named = "struct(n.parent AS parent, n.path AS path, n.in_list AS in_list, n.type AS type)"
    level_by_level = f"transform({expand_sql(root, expanded)}, n -> {named})"
    opened = _schema_sql(record, "CAST(NULL AS STRING)", "''", False, NESTED_DEPTH)
    chosen = f"if(exists(nodes, x -> x.type = '{_UNOPENED}'), {level_by_level}, nodes)"
    return f"if({record} IS NULL, NULL, {let(opened, 'nodes', chosen)})"


_UNOPENED = "unopened"


def _schema_sql(value: str, parent: str, path: str, in_list: bool, depth: int) -> str:
    """The nodes of a value by nested expressions over `depth` levels; lists in lists and what lies deeper are `_UNOPENED`."""
    entry, item, at = (f"{name}{depth}" for name in ("e", "x", "p"))

    def own(kind: str) -> str:
        return f"array(struct({parent} AS parent, {at} AS path, {in_list} AS in_list, {kind} AS type))"

    whole = own(let(type_name_sql(value), "name", f"if(name IN ('list', 'dict'), '{_UNOPENED}', name)"))
    if depth == 0:
        return let(path, at, whole)
    key = f"if({at} = '', {entry}.key, concat({at}, ' ', {entry}.key))"
    below = _schema_sql(f"{entry}.value", at, key, False, depth - 1)
    members = f"concat({own("'dict'")}, flatten(transform(map_entries({map_sql(value)}), {entry} -> {below})))"
    below = _schema_sql(item, at, f"concat({at}, '[]')", True, depth - 1)
    items = "" if in_list else f"concat({own("'list'")}, flatten(transform({list_sql(value)}, {item} -> {below}))), "
    return let(path, at, f"coalesce({members}, {items}{whole})")
