"""DuckDB SQL for the queries of `workload.queries`, written independently of the Spark code."""

from __future__ import annotations

SCHEMA_STR = "{''lang'': ''str'', ''source'': ''str''}"

# --- derived tables -----------------------------------------------------------------

PART = "'p_name': p_name, 'p_brand': p_brand, 'p_type': p_type, 'p_size': p_size, 'p_retailprice': p_retailprice"

D1 = f"d1 AS (SELECT p_partkey AS id, to_json({{{PART}}})::VARCHAR AS record_json FROM part)"

D1N = """d1l AS (
  SELECT l_orderkey, list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey,
                           'l_quantity': l_quantity, 'l_extendedprice': l_extendedprice,
                           'l_returnflag': l_returnflag}
                          ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS lines
  FROM lineitem GROUP BY l_orderkey),
d1n AS (
  SELECT o_orderkey AS id,
         to_json({'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice,
                  'buyer': {'key': o_custkey, 'priority': o_orderpriority},
                  'lines': coalesce(lines, [])})::VARCHAR AS record_json
  FROM orders LEFT JOIN d1l ON l_orderkey = o_orderkey)"""

D2 = """d2p AS (
  SELECT p_partkey AS id, p_partkey % 11 AS kind,
         'The part''s name is ''' || p_name || ''' and it is ' || p_type AS input,
         '{''p_name'': ''' || p_name || ''', ''p_brand'': ''' || p_brand || '''' AS head,
         ', ''p_size'': ' || p_size || ', ''p_retailprice'': ' || p_retailprice AS tail, p_size
  FROM part),
d2 AS (
  SELECT id, input, CASE kind
    WHEN 0 THEN head || ', ''note'': nan' || tail || '}'
    WHEN 1 THEN head || tail || ', ''note'': nan}'
    WHEN 2 THEN head || ', ''note'': ''''' || tail || '}'
    WHEN 3 THEN head || ', ''note'': None' || tail || '}'
    WHEN 4 THEN head || ', ''note'': True' || tail || '}'
    WHEN 5 THEN head || ', ''note'': ''1/2/2016''' || tail || '}'
    WHEN 6 THEN head || ', ''note'': "don''t"' || tail || '}'
    WHEN 7 THEN head || ', ''note'': "l''été"' || tail || '}'
    WHEN 8 THEN head || ', ''note'': ''one' || chr(10) || 'two''' || tail || '}'
    WHEN 9 THEN '{}'
    ELSE '[' || p_size || ', ''x'']' END AS output
  FROM d2p)"""

# the same with only mended kinds below the middle key
D2_LATE = D2.replace(
    "p_partkey % 11 AS kind",
    "CASE WHEN p_partkey < (SELECT max(p_partkey) / 2.0 FROM part) THEN p_partkey % 2 * 5 ELSE p_partkey % 11 END AS kind",
)

D3 = f"""d3 AS (
  SELECT p_partkey AS pair_id, to_json({{{PART}}})::VARCHAR AS expected_json,
    CASE p_partkey % 6
      WHEN 0 THEN to_json({{{PART}}})
      WHEN 1 THEN to_json({{'p_name': p_name, 'p_type': p_type, 'p_size': p_size, 'p_retailprice': p_retailprice}})
      WHEN 2 THEN to_json({{{PART}, 'p_extra': 'new'}})
      WHEN 3 THEN to_json({{'p_name': p_name || ' deluxe', 'p_brand': p_brand, 'p_type': p_type,
                           'p_size': p_size + 1, 'p_retailprice': p_retailprice}})
      WHEN 4 THEN to_json({{'p_name': p_name, 'p_brand': p_brand, 'p_type': p_type,
                           'p_size': p_size::VARCHAR, 'p_retailprice': p_retailprice}})
      ELSE to_json({{'p_name': p_name, 'p_brand': p_brand, 'p_size': p_size,
                    'p_retailprice': p_retailprice, 'kind': p_type}}) END::VARCHAR AS predicted_json
  FROM part)"""

D4 = f"""d4p AS (
  SELECT p_partkey AS id, p_name, p_partkey % 6 AS kind, to_json({{{PART}}})::VARCHAR AS expected_json,
    '{{''p_name'': ''' || p_name || ''', ''p_brand'': ''' || p_brand || ''', ''p_type'': ''' || p_type
      || ''', ''p_size'': ' || p_size || ', ''p_retailprice'': ' || p_retailprice || '}}' AS quoted
  FROM part),
d4 AS (
  SELECT id, expected_json, CASE kind
    WHEN 0 THEN expected_json
    WHEN 1 THEN 'Here is the record: ' || quoted || ' and {{more}} below.'
    WHEN 2 THEN 'Answer: ' || replace(expected_json, '"', '\\"')
    WHEN 3 THEN '}} ' || expected_json
    WHEN 4 THEN 'There is no record of ' || p_name
    ELSE left(expected_json, length(expected_json) - 1) END AS generated_output
  FROM d4p)"""

_LINE = ", ".join(
    f"'{name}': lines[1].{name}{' + 1' if name == 'l_quantity' else ''}"
    for name in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
)


def _order(status: str = "o_orderstatus", buyer: str = "{'key': o_custkey, 'priority': o_orderpriority}", lines: str = "lines") -> str:
    return f"to_json({{'{status}': o_orderstatus, 'o_totalprice': o_totalprice, 'buyer': {buyer}, 'lines': {lines}}})"


D5 = f"""{D1N},
d5o AS (SELECT * REPLACE (coalesce(lines, []) AS lines) FROM orders LEFT JOIN d1l ON l_orderkey = o_orderkey),
d3 AS (
  SELECT o_orderkey AS pair_id, {_order()}::VARCHAR AS expected_json,
    CASE o_orderkey % 6
      WHEN 0 THEN {_order()}
      WHEN 1 THEN {_order(buyer="{'key': o_custkey}")}
      WHEN 2 THEN {_order(lines=f"CASE WHEN len(lines) > 0 THEN list_concat([{{{_LINE}}}], lines[2:]) ELSE lines END")}
      WHEN 3 THEN {_order(lines="CASE WHEN len(lines) > 0 THEN lines[1:len(lines) - 1] ELSE lines END")}
      WHEN 4 THEN {_order(buyer="{'key': o_custkey::VARCHAR, 'priority': o_orderpriority}")}
      ELSE {_order(status="status")} END::VARCHAR AS predicted_json
  FROM d5o)"""

LAB = "lab AS (SELECT doc_id, to_json({'quality': quality, 'toxic': toxic})::VARCHAR AS structured FROM labels)"


# --- building blocks ----------------------------------------------------------------


def type_of(json: str) -> str:
    return (
        f"CASE json_type({json}) WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' "
        "WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' "
        "WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' END"
    )


def text_of(json: str) -> str:
    return f"CASE WHEN json_type({json}) = 'VARCHAR' THEN {json} ->> '$' ELSE {json}::VARCHAR END"


def sorted_json(json: str) -> str:
    """JSON text of a flat object with sorted keys."""
    return (
        f"(SELECT '{{' || string_agg(to_json(k) || ':' || ({json}::JSON -> k)::VARCHAR, ',' ORDER BY k) || '}}' "
        f"FROM (SELECT unnest(json_keys({json})) AS k))"
    )


def prompt(schema: str, text: str, instruct: bool) -> str:
    """The two layouts, with line breaks standing in the SQL literal."""
    if instruct:
        return f"""'
            [INST]
            Populate a JSON in the JSON_SCHEMA format from the provided TEXT_DATA.
            ---
            JSON_SCHEMA: ' || {schema} || '
            ---
            TEXT_DATA: ' || {text} || '
            [\\INST]
        '"""
    return f"""'
            Populate a JSON in the JSON_SCHEMA format from the provided TEXT_DATA.
            ---
            JSON_SCHEMA: ' || {schema} || '
            ---
            TEXT_DATA: ' || {text} || '
            ---
            OUTPUT:
        '"""


def training_text(prompt_sql: str, output: str) -> str:
    return f"""'
            ' || {prompt_sql} || '
            ' || {output} || '
            '"""


def with_(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


# Repair of D2: quotes are judged one character at a time from their neighbours.
WORD = "[\\p{L}\\p{N}_]"
REPAIRED = f"""rep0 AS (SELECT id, input, output, replace(replace(output, ' ''S', '''S'), ' nan,', '"None",') AS s FROM d2),
rep1 AS (
  SELECT id, input, output, list_transform(range(1, length(s) + 1), lambda i:
      {{'c': substring(s, i, 1), 'p': CASE WHEN i = 1 THEN '' ELSE substring(s, i - 1, 1) END, 'n': substring(s, i + 1, 1)}}) AS cs
  FROM rep0),
rep2 AS (
  SELECT id, input, output, array_to_string(list_transform(cs, lambda x:
      CASE WHEN x.c = '''' AND ((NOT regexp_matches(x.p, '{WORD}') AND x.n <> '''')
                             OR (x.p <> '''' AND NOT regexp_matches(x.n, '{WORD}'))) THEN '"' ELSE x.c END), '') AS s
  FROM rep1),
repaired AS (
  SELECT id, input, output, replace(replace(replace(s, chr(10), ' '), '/', ' or '), '""', '"') AS r FROM rep2),
judged AS (
  SELECT id, input, output, r,
    CASE WHEN NOT json_valid(r) OR regexp_matches(r, ': *nan') THEN 'not_json'
         WHEN json_type(r) <> 'OBJECT' THEN 'not_object'
         WHEN len(json_keys(r)) = 0 THEN 'empty_record' END AS reason
  FROM repaired)"""


def formatted(instruct: bool, renames: dict[str, str] | None = None) -> str:
    """CTE `fmt`: the usable rows of D2 with record, schema, prompt and text."""
    name = "k"
    for old, new in (renames or {}).items():
        name = f"CASE WHEN k = '{old}' THEN '{new}' ELSE {name} END"
    rendered = prompt("schema_str", "input", instruct)
    return f"""ent AS (
  SELECT id, input, {name} AS name, (r::JSON -> k) AS v
  FROM (SELECT id, input, r, unnest(json_keys(r)) AS k FROM judged WHERE reason IS NULL)),
rec AS (
  SELECT id, input,
    '{{' || string_agg(to_json(name) || ':' || v::VARCHAR, ',' ORDER BY name) || '}}' AS output,
    '{{' || string_agg(to_json(name) || ':"' || {type_of("v")} || '"', ',' ORDER BY name) || '}}' AS schema_str
  FROM ent GROUP BY id, input),
pro AS (SELECT *, {rendered} AS preprocessed_input FROM rec),
fmt AS (SELECT *, {training_text("preprocessed_input", "output")} AS text FROM pro)"""


# Fields of D3 as rows, one table per side.
def side(name: str, column: str) -> str:
    return f"""{name} AS (
  SELECT pair_id, k AS path, {type_of("v")} AS type, {text_of("v")} AS text
  FROM (SELECT pair_id, k, {column}::JSON -> k AS v FROM (SELECT pair_id, {column}, unnest(json_keys({column})) AS k FROM d3)))"""


FIELDS = f"""{side("lf", "expected_json")},
{side("rf", "predicted_json")},
fields AS (
  SELECT pair_id, path, lf.type AS l_type, lf.text AS l_text, rf.type AS r_type, rf.text AS r_text
  FROM lf FULL OUTER JOIN rf USING (pair_id, path))"""

def deep_side(name: str, column: str) -> str:
    """Leaves of the nested records of D5, taken from the tree of the JSON."""
    return f"""{name} AS (
  SELECT pair_id, replace(substring(t.fullkey, 3), '.', ' ') AS path, {type_of("t.value")} AS type,
    CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' ELSE t.atom::VARCHAR END AS text
  FROM d3, json_tree(d3.{column}) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))"""


D5F = (
    D5,
    f"""{deep_side("lf", "expected_json")},
{deep_side("rf", "predicted_json")},
fields AS (
  SELECT pair_id, path, lf.type AS l_type, lf.text AS l_text, rf.type AS r_type, rf.text AS r_text
  FROM lf FULL OUTER JOIN rf USING (pair_id, path))""",
)

MISSING = """SELECT pair_id, path, 'Dict 1' AS missing_in FROM (SELECT pair_id, path FROM rf EXCEPT SELECT pair_id, path FROM lf)
    UNION ALL SELECT pair_id, path, 'Dict 2' FROM (SELECT pair_id, path FROM lf EXCEPT SELECT pair_id, path FROM rf)"""

BASIC = """basic AS (
  SELECT pair_id,
    count(*) FILTER (l_type IS NOT NULL AND r_type IS NOT NULL) / count(*) AS jaccard_similarity,
    coalesce(avg(CASE WHEN l_type = r_type AND l_text = r_text THEN 1.0
                      WHEN l_type IN ('int', 'float') AND r_type IN ('int', 'float')
                           AND try_cast(l_text AS DOUBLE) = try_cast(r_text AS DOUBLE) THEN 1.0 ELSE 0.0 END)
             FILTER (l_type IS NOT NULL AND r_type IS NOT NULL), 0.0) AS value_similarity
  FROM fields GROUP BY pair_id)"""


def bag(name: str, column: str) -> str:
    return f"""{name} AS (
  SELECT pair_id, path, word, count(*) AS c
  FROM (SELECT pair_id, path, unnest(regexp_extract_all(lower(path || ': ' || {column}), '[\\p{{L}}\\p{{N}}_]+')) AS word
        FROM fields WHERE l_text <> r_text)
  GROUP BY ALL)"""


SCORED = f"""{bag("lw", "l_text")},
{bag("rw", "r_text")},
dots AS (SELECT pair_id, path, sum(lw.c * rw.c) AS d FROM lw JOIN rw USING (pair_id, path, word) GROUP BY ALL),
ln AS (SELECT pair_id, path, sum(c * c) AS n FROM lw GROUP BY ALL),
rn AS (SELECT pair_id, path, sum(c * c) AS n FROM rw GROUP BY ALL),
scored AS (
  SELECT f.*, CASE WHEN l_text = r_text THEN 1.0::DOUBLE
                   WHEN l_text <> r_text THEN coalesce(d::DOUBLE / sqrt(ln.n::DOUBLE * rn.n::DOUBLE), 0.0) END AS similarity
  FROM fields f LEFT JOIN dots USING (pair_id, path) LEFT JOIN ln USING (pair_id, path) LEFT JOIN rn USING (pair_id, path))"""


def decided(threshold: float) -> str:
    return f"""decided AS (
  SELECT *, CASE WHEN l_type IS NULL THEN 'missing in Dict 1' WHEN r_type IS NULL THEN 'missing in Dict 2'
                 WHEN l_text = r_text OR similarity = 1 THEN 'good'
                 WHEN similarity >= {threshold} THEN 'minor difference' ELSE 'value mismatch' END AS decision
  FROM scored),
scores AS (
  SELECT pair_id, avg(CASE WHEN decision IN ('good', 'minor difference') THEN 1.0 ELSE 0.0 END) AS similarity_score
  FROM decided GROUP BY pair_id)"""


def compared(divide: str = "") -> str:
    return f"""compared AS (
  SELECT pair_id, jaccard_similarity, value_similarity, similarity_score,
    0.48 * abs(1 - jaccard_similarity) + 0.04 * abs(1 - value_similarity)
      + 0.48 * abs(1 - similarity_score{divide}) AS weighted_mape
  FROM basic JOIN scores USING (pair_id))"""


# TF-IDF of the values of D3, aligned by the place of their keys in sorted order.
TFIDF = """vals AS (
  SELECT pair_id, 'l' AS side, row_number() OVER (PARTITION BY pair_id ORDER BY path) - 1 AS pos, text FROM lf
  UNION ALL
  SELECT pair_id, 'r', row_number() OVER (PARTITION BY pair_id ORDER BY path) - 1, text FROM rf),
sizes AS (
  SELECT pair_id, count(*) AS docs, least(count(*) FILTER (side = 'l'), count(*) FILTER (side = 'r')) AS compared
  FROM vals GROUP BY pair_id),
tf AS (
  SELECT pair_id, side, pos, term, count(*) AS tf
  FROM (SELECT pair_id, side, pos, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM vals)
  GROUP BY ALL),
weights AS (
  SELECT pair_id, side, pos, term,
    tf * (ln((1.0 + docs) / (1.0 + count(*) OVER (PARTITION BY pair_id, term))) + 1.0) AS w
  FROM tf JOIN sizes USING (pair_id)),
lengths AS (SELECT pair_id, side, pos, sqrt(sum(w * w)) AS n FROM weights GROUP BY ALL),
unit AS (SELECT pair_id, side, pos, term, w / n AS w FROM weights JOIN lengths USING (pair_id, side, pos)),
products AS (
  SELECT pair_id, pos, sum(a.w * b.w) AS c
  FROM (SELECT * FROM unit WHERE side = 'l') a JOIN (SELECT * FROM unit WHERE side = 'r') b USING (pair_id, pos, term)
  GROUP BY ALL),
cosines AS (
  SELECT pair_id, pos, coalesce(c, 0.0) AS tfidf_cosine
  FROM (SELECT pair_id, unnest(range(compared)) AS pos FROM sizes) LEFT JOIN products USING (pair_id, pos))"""


# Exact word counts of the fields of D3, labelled by side, and the cosine of any two of a pair.
WORD_VECTORS = """labelled AS (
  SELECT pair_id, path || ' (Dict 1)' AS label, 'Dict 1' AS side, path || ': ' || text AS field FROM lf
  UNION ALL SELECT pair_id, path || ' (Dict 2)', 'Dict 2', path || ': ' || text FROM rf),
counted AS (
  SELECT pair_id, label, word, count(*) AS c
  FROM (SELECT pair_id, label, unnest(regexp_extract_all(lower(field), '[\\p{L}\\p{N}_]+')) AS word FROM labelled) GROUP BY ALL),
squares AS (SELECT pair_id, label, sum(c * c) AS n FROM counted GROUP BY ALL),
shared AS (
  SELECT a.pair_id, a.label AS l, b.label AS r, sum(a.c * b.c) AS d
  FROM counted a JOIN counted b USING (pair_id, word) GROUP BY ALL),
cells AS (
  SELECT a.pair_id, a.label AS "left", b.label AS "right", a.side AS l_side, b.side AS r_side,
    round(coalesce(d::DOUBLE / sqrt(ln.n::DOUBLE * rn.n::DOUBLE), 0.0), 6) AS cosine
  FROM labelled a JOIN labelled b USING (pair_id)
  LEFT JOIN shared s ON s.pair_id = a.pair_id AND s.l = a.label AND s.r = b.label
  LEFT JOIN squares ln ON ln.pair_id = a.pair_id AND ln.label = a.label
  LEFT JOIN squares rn ON rn.pair_id = a.pair_id AND rn.label = b.label)"""


def vectors(size: int) -> str:
    """Field vectors of D3 as the stand-in embedder gives them, labelled by side."""

    def one(table: str, label: str) -> str:
        return f"SELECT pair_id, path || ' ({label})' AS label, '{label}' AS side, path || ': ' || text AS field FROM {table}"

    return f"""labelled AS ({one("lf", "Dict 1")} UNION ALL {one("rf", "Dict 2")}),
places AS (
  SELECT *, list_transform(regexp_extract_all(lower(field), '[\\p{{L}}\\p{{N}}_]+'),
                           lambda w: ('0x' || substring(md5(w), 1, 6))::BIGINT % {size}) AS ps FROM labelled),
vecs AS (
  SELECT pair_id, label, side, list_transform(range({size}), lambda p: len(list_filter(ps, lambda x: x = p))::DOUBLE) AS v
  FROM places)"""


# Parsing of D4.
CASCADE = """chars AS (
  SELECT id, expected_json, generated_output AS g,
    regexp_replace(generated_output, '^\\s+|\\s+$', '', 'g') AS stripped,
    list_transform(range(1, length(generated_output) + 1), lambda i:
      {'c': substring(generated_output, i, 1), 'p': CASE WHEN i = 1 THEN '' ELSE substring(generated_output, i - 1, 1) END,
       'pp': CASE WHEN i < 3 THEN '' ELSE substring(generated_output, i - 2, 2) END}) AS cs
  FROM d4),
quoted AS (
  SELECT id, expected_json, g,
    CASE WHEN substring(replace(stripped, chr(10), ''), 2, 1) IN ('"', '') THEN g
         ELSE array_to_string(list_transform(cs, lambda x:
           CASE WHEN x.c = '''' AND x.p <> '\\' AND x.pp <> '\\''' THEN '"' ELSE x.c END), '') END AS q
  FROM chars),
marks AS (
  SELECT id, i, substring(q, i, 1) AS c
  FROM (SELECT id, q, unnest(range(1, length(q) + 1)) AS i FROM quoted) WHERE substring(q, i, 1) IN ('{', '}')),
depths AS (
  SELECT id, i, c, sum(CASE c WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY i) AS depth FROM marks),
ends AS (SELECT id, min(i) AS e FROM depths WHERE c = '}' AND depth = 0 GROUP BY id),
starts AS (
  SELECT id, max(i) AS b, any_value(e) AS e FROM depths JOIN ends USING (id)
  WHERE c = '{' AND depth = 1 AND i < e GROUP BY id),
objects AS (
  SELECT id, expected_json, g, q, CASE WHEN e IS NOT NULL THEN substring(q, b, e - b + 1) END AS o
  FROM quoted LEFT JOIN starts USING (id)),
parsed AS (
  SELECT id, expected_json, g, q, o,
    CASE WHEN json_valid(g) THEN g WHEN json_valid(replace(o, '\\', '')) THEN replace(o, '\\', '') END AS record
  FROM objects)"""

ENTRY_JSON = """to_json({'lang': lang, 'quality': quality, 'source': source, 'toxic': toxic})::VARCHAR"""

# --- queries ------------------------------------------------------------------------

LABELLED = "FROM documents LEFT JOIN lab USING (doc_id)"
D3F = (D3, FIELDS)
MAPPING = {"p_name": "name", "p_brand": "brand", "p_size": "size"}

ORACLE_SQL: dict[str, str] = {
    "s1_csv_roundtrip": with_(LAB)
    + f"SELECT doc_id, text AS raw, coalesce(structured, '{{}}') AS structured {LABELLED}",
    "s3_training_table": with_(D2, REPAIRED, formatted(False))
    + "SELECT input, preprocessed_input, output, text FROM fmt",
    "s4_doc_scan": "SELECT page_id, regexp_extract(url, '[^/]*$') AS file_name, html AS text FROM pages WHERE url LIKE '%#top'",
    "s6_export_split": """SELECT doc_id, lang, source, CASE WHEN place <= ceil(0.3::DOUBLE * n) THEN 'eval' ELSE 'train' END AS split FROM (
        SELECT *, row_number() OVER (ORDER BY md5('1738:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM documents)""",
    "p1_concat_pages": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "p1b_chunk": """SELECT doc_id, (s // 900)::INTEGER AS pos, substring(text, s + 1, 1000) AS chunk
        FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100 - 1, 0) + 1, 900)) AS s FROM documents)""",
    "p2_strip_apostrophes": with_(D2)
    + "SELECT id, replace(input, '''', '') AS input, replace(output, '''', '') AS output FROM d2",
    "p3_strip_escapes": with_(D4) + "SELECT id, replace(generated_output, '\\', '') AS stripped FROM d4",
    "p5_pack_record": """SELECT c_custkey,
        to_json({'c_custkey': c_custkey, 'c_nationkey': c_nationkey, 'c_acctbal': CASE WHEN c_acctbal > 0 THEN c_acctbal END,
                 'c_mktsegment': c_mktsegment})::VARCHAR AS record,
        CASE WHEN c_acctbal > 0
          THEN to_json({'c_custkey': c_custkey, 'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment})
          ELSE to_json({'c_custkey': c_custkey, 'c_nationkey': c_nationkey, 'c_acctbal': 'None', 'c_mktsegment': c_mktsegment})
        END::VARCHAR AS record_none FROM customer""",
    "p6_prompt": f"""SELECT doc_id, CASE WHEN lang = 'en' THEN {prompt(f"'{SCHEMA_STR}'", "text", True)}
        ELSE {prompt(f"'{SCHEMA_STR}'", "text", False)} END AS preprocessed_input FROM documents""",
    "p7_text": with_(LAB, f"""pr AS (SELECT doc_id, coalesce(structured, '{{}}') AS output,
        {prompt(f"'{SCHEMA_STR}'", "text", True)} AS p {LABELLED})""")
    + f"SELECT doc_id, {training_text('p', 'output')} AS text FROM pr",
    "p12_quarantine": with_(D2, REPAIRED) + "SELECT id, reason FROM judged WHERE reason IS NOT NULL",
    "j1_metadata_lookup": with_(LAB) + f"SELECT doc_id, source, coalesce(structured, '{{}}') AS structured {LABELLED}",
    "j2_field_outer": with_(*D3F) + "SELECT pair_id, path, l_type, l_text, r_type, r_text FROM fields",
    "j4_missing_fields": with_(*D3F)
    + MISSING,
    "j2_nested_fields": with_(*D5F) + "SELECT pair_id, path, l_type, l_text, r_type, r_text FROM fields",
    "j4_nested_missing": with_(*D5F) + MISSING,
    "j5_pairwise_cosine": with_(*D3F, WORD_VECTORS) + 'SELECT pair_id, "left", "right", cosine FROM cells',
    "j6_cross_block": with_(*D3F, WORD_VECTORS)
    + """SELECT pair_id, "left", "right", cosine FROM cells WHERE l_side = 'Dict 1' AND r_side = 'Dict 2'""",
    "j6_block_embedded": with_(*D3F, vectors(16))
    + """SELECT pair_id, a.label AS "left", b.label AS "right", round(list_cosine_similarity(a.v, b.v), 6) AS cosine
    FROM vecs a JOIN vecs b USING (pair_id) WHERE a.side = 'Dict 1' AND b.side = 'Dict 2'""",
    "a1_key_jaccard": with_(*D3F, BASIC)
    + "SELECT pair_id, round(jaccard_similarity, 6) AS jaccard_similarity FROM basic",
    "a2_key_overlap": with_(D3)
    + """SELECT pair_id, round(len(list_intersect(json_keys(expected_json), json_keys(predicted_json)))
      / len(list_distinct(list_concat(json_keys(expected_json), json_keys(predicted_json)))), 6) AS key_similarity FROM d3""",
    "a3_value_match": with_(*D3F, BASIC)
    + "SELECT pair_id, round(value_similarity::DOUBLE, 6) AS value_similarity FROM basic",
    "a5_tfidf_mean": with_(*D3F, TFIDF)
    + "SELECT pair_id, round(avg(tfidf_cosine), 6) AS tfidf_mean FROM cosines GROUP BY pair_id",
    "a6_list_similarity": """WITH ls AS (
      SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l,
        coalesce(list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (l_quantity > 10), []) AS r
      FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, round(coalesce(list_sum(list_transform(range(1, least(len(l), len(r)) + 1),
      lambda i: 1.0::DOUBLE / (1 + abs(l[i] - r[i])))), 0.0) / greatest(len(l), len(r)), 6) AS similarity FROM ls""",
    "a7_decision_score": with_(*D3F, SCORED, decided(0.8))
    + "SELECT pair_id, round(similarity_score::DOUBLE, 6) AS similarity_score FROM scores",
    "a8_weighted_mape": with_(*D3F, BASIC, SCORED, decided(0.9), compared(" / 100"))
    + "SELECT pair_id, round(weighted_mape::DOUBLE, 6) AS weighted_mape FROM compared",
    "a9_seq_budget": """WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))::INTEGER AS n FROM documents)
    SELECT 'all rows' AS mode, max(n) AS tokens, floor(1.1::DOUBLE * max(n))::INTEGER AS budget FROM c
    UNION ALL SELECT 'first row', arg_min(n, doc_id), floor(1.1::DOUBLE * arg_min(n, doc_id))::INTEGER FROM c""",
    "a11_signature": """WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT * FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'),
      (3, 'source', 'string'), (4, 'n_chars', 'bigint'), (5, 'quality', 'int'), (6, 'toxic', 'int')) v(pos, name, type)),
    n AS (UNPIVOT (SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (text IS NULL) AS text,
      count(*) FILTER (lang IS NULL) AS lang, count(*) FILTER (source IS NULL) AS source,
      count(*) FILTER (n_chars IS NULL) AS n_chars, count(*) FILTER (quality IS NULL) AS quality,
      count(*) FILTER (toxic IS NULL) AS toxic FROM j) ON COLUMNS(*) INTO NAME name VALUE nulls)
    SELECT pos, name, type, nulls, nulls = 0 AS required FROM s JOIN n USING (name)""",
    "a12_last_wins": """WITH f(id, ord, path, type, text) AS (
      SELECT p_partkey, 1, 'size in cm', 'int', p_size::VARCHAR FROM part
      UNION ALL SELECT p_partkey, 2, 'size kind', 'str', p_type FROM part
      UNION ALL SELECT p_partkey, 3, 'size in cm', 'int', (p_size + 1)::VARCHAR FROM part
      UNION ALL SELECT p_partkey, 4, 'size kind', 'str', p_name FROM part
      UNION ALL SELECT p_partkey, 0, 'brand', 'str', p_brand FROM part)
    SELECT id, path, arg_max(type, ord) AS type, arg_max(text, ord) AS text FROM f GROUP BY id, path""",
    "a14_mean_pool": """SELECT label, (pos - 1)::INTEGER AS pos, round(avg(x::DOUBLE), 6) AS mean
    FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY ALL""",
    "a15_schema_profile": with_(D3)
    + f"""SELECT k AS key, {type_of("v")} AS type, count(*) AS records
    FROM (SELECT k, predicted_json::JSON -> k AS v FROM (SELECT predicted_json, unnest(json_keys(predicted_json)) AS k FROM d3)) GROUP BY ALL""",
    "w1_stop_first_bad": with_(
        D2, REPAIRED, formatted(False), "m AS (SELECT min(id) FILTER (reason IS NOT NULL) AS bad FROM judged)",
        "prev AS (SELECT arg_max(schema_str, id) AS schema_str FROM fmt, m WHERE id < bad)",
    )
    + f"""SELECT j.id, CASE WHEN j.id < bad THEN f.output ELSE j.output END AS output,
      CASE WHEN j.id < bad THEN f.preprocessed_input WHEN j.id = bad
           THEN {prompt("coalesce(prev.schema_str, '')", "j.input", False)} END AS preprocessed_input,
      CASE WHEN j.id < bad THEN f.text END AS text
    FROM judged j LEFT JOIN fmt f USING (id) CROSS JOIN m CROSS JOIN prev""",
    "w2_schema_carry": with_(
        D2, REPAIRED, formatted(False), "m AS (SELECT min(id) FILTER (reason IS NOT NULL) AS bad FROM judged)",
        "own AS (SELECT j.id, f.schema_str, lag(f.schema_str) OVER (ORDER BY j.id) AS carried FROM judged j LEFT JOIN fmt f USING (id))",
    )
    + """SELECT id, CASE WHEN id < bad THEN schema_str WHEN id = bad THEN coalesce(carried, '') END AS schema_str FROM own, m""",
    "w3_split_exact": """SELECT doc_id, CASE WHEN place <= ceil(0.3::DOUBLE * n) THEN 'eval' ELSE 'train' END AS split FROM (
      SELECT doc_id, row_number() OVER (ORDER BY md5('1738:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM documents)""",
    "w3_split_hash": """SELECT doc_id, CASE WHEN ('0x' || substring(md5('1738:' || doc_id), 1, 8))::BIGINT % 10000 < 3000
      THEN 'eval' ELSE 'train' END AS split FROM documents""",
    "w4_row_index": """SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS row FROM events""",
    "l1_input_example": with_(D2, REPAIRED, formatted(False))
    + "SELECT id, input, preprocessed_input, output, text FROM fmt ORDER BY id LIMIT 5",
    "l2_canonical": with_(D3) + f"SELECT pair_id, {sorted_json('predicted_json')} AS canonical FROM d3",
    "l2_nested_canonical": with_(D1N)
    + """SELECT o_orderkey AS id, to_json({'buyer': {'key': o_custkey, 'priority': o_orderpriority},
      'lines': list_transform(coalesce(lines, []), lambda x: {'l_extendedprice': x.l_extendedprice, 'l_linenumber': x.l_linenumber,
        'l_partkey': x.l_partkey, 'l_quantity': x.l_quantity, 'l_returnflag': x.l_returnflag, 'l_suppkey': x.l_suppkey}),
      'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice})::VARCHAR AS canonical
    FROM orders LEFT JOIN d1l ON l_orderkey = o_orderkey""",
    "x1_key_sets": with_(D3, "k AS (SELECT pair_id, json_keys(expected_json) AS l, json_keys(predicted_json) AS r FROM d3)")
    + """SELECT pair_id, array_to_string(list_sort(list_distinct(list_concat(l, r))), ',') AS all_keys,
      array_to_string(list_sort(list_intersect(l, r)), ',') AS common_keys,
      array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(r, x))), ',') AS left_only,
      array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(l, x))), ',') AS right_only FROM k""",
    "f1_repair": with_(D2, REPAIRED) + "SELECT id, r AS repaired FROM repaired",
    "f2_quotes": with_(D4, CASCADE) + "SELECT id, q AS quoted FROM quoted",
    # The first object of the raw text: nothing in D4 changes its braces, so places agree with the quoted text.
    "f3_first_object": with_(D4, CASCADE)
    + "SELECT id, CASE WHEN e IS NOT NULL THEN substring(g, b, e - b + 1) END AS first_object FROM quoted LEFT JOIN starts USING (id)",
    "f4_strict_parse": with_(D4) + "SELECT id, json_valid(generated_output) AS parses FROM d4",
    "f5_parse_cascade": with_(D4, CASCADE)
    + f"SELECT id, CASE WHEN record IS NOT NULL THEN {sorted_json('record')} END AS record FROM parsed",
    "f6_rename_schema_to_json": """SELECT p_partkey AS id,
      to_json({'kind': p_type, 'p_brand': p_brand, 'p_name': p_size, 'p_retailprice': p_retailprice})::VARCHAR AS record FROM part""",
    "f6_rename_json_to_schema": """SELECT p_partkey AS id,
      to_json({'brand': p_brand, 'name': p_name, 'p_retailprice': p_retailprice, 'p_type': p_type, 'size': p_size})::VARCHAR AS record
      FROM part""",
    "f7_type_names": with_(D1N)
    + f"""SELECT id, k AS key, {type_of("v")} AS type FROM (
      SELECT id, k, record_json::JSON -> k AS v FROM (SELECT id, record_json, unnest(json_keys(record_json)) AS k FROM d1n))""",
    "f8_schema_str": with_(D1N)
    + f"""SELECT id, '{{' || string_agg(to_json(k) || ':"' || {type_of("v")} || '"', ',' ORDER BY k) || '}}' AS schema_str FROM (
      SELECT id, k, record_json::JSON -> k AS v FROM (SELECT id, record_json, unnest(json_keys(record_json)) AS k FROM d1n))
      GROUP BY id""",
    "f9_flatten": with_(D1N)
    + f"""SELECT d.id AS id, replace(substring(t.fullkey, 3), '.', ' ') AS path, {type_of("t.value")} AS type,
      CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' ELSE t.atom::VARCHAR END AS text
      FROM d1n d, json_tree(d.record_json) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""",
    "f11_lev_ratio": with_(D3)
    + """SELECT pair_id, round(1.0::DOUBLE - levenshtein(expected_json, predicted_json)::DOUBLE
      / greatest(length(expected_json), length(predicted_json)), 6) AS ratio FROM d3""",
    "f13_char_overlap": with_(D3)
    + """SELECT pair_id, round(2.0::DOUBLE * len(list_filter(string_split(expected_json, ''), lambda c: contains(predicted_json, c)))
      / (length(expected_json) + length(predicted_json)), 6) AS overlap FROM d3""",
    "f14_value_similarity": with_(*D3F)
    + """SELECT pair_id, path AS key, round(CASE
      WHEN l_type = 'str' AND r_type = 'str' THEN
        2.0::DOUBLE * len(list_filter(string_split(l_text, ''), lambda c: contains(r_text, c))) / (length(l_text) + length(r_text))
      WHEN l_type IN ('int', 'float') AND r_type IN ('int', 'float') THEN
        1.0::DOUBLE / (1 + abs(try_cast(l_text AS DOUBLE) - try_cast(r_text AS DOUBLE)))
      ELSE 0.0::DOUBLE END, 6) AS similarity
    FROM fields WHERE l_type IS NOT NULL AND r_type IS NOT NULL""",
    "f15_tokens": """SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents)""",
    "f16_tfidf": """WITH tf AS (
      SELECT doc_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT doc_id, term, tf, df, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS raw
      FROM tf JOIN dfs USING (term))
    SELECT doc_id, term, tf, df, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""",
    "f18_tfidf_similarity": with_(*D3F, TFIDF)
    + "SELECT pair_id, pos::INTEGER AS pos, round(tfidf_cosine, 6) AS tfidf_cosine FROM cosines",
    "f22_decisions": with_(*D3F, SCORED, decided(0.8)) + "SELECT pair_id, path, decision FROM decided",
    "f25_run_id": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS run_id,
      'runs/training/' || event_type || '/' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS run_path FROM events""",
    "u1_batch_generate": """SELECT doc_id, 'Sure: {"chars": ' || length(text) || ', "limit": 50}' AS generated_output FROM documents""",
    "u2_embed_distinct": """WITH f AS (SELECT p_partkey, 'p_name: ' || p_name AS field FROM part),
    h AS (SELECT *, list_transform(regexp_extract_all(lower(field), '[\\p{L}\\p{N}_]+'),
      lambda w: ('0x' || substring(md5(w), 1, 6))::BIGINT % 16) AS ps FROM f)
    SELECT p_partkey, field, array_to_string(list_transform(range(16), lambda p: len(list_filter(ps, lambda x: x = p))), ',') AS vector
    FROM h""",
    "c0_build_pairs": with_(LAB, """doc AS (SELECT conv_id, replace(string_agg(text, ' ' ORDER BY turn), '''', '') AS input
      FROM conversations GROUP BY conv_id)""")
    + "SELECT conv_id, input, coalesce(structured, '{}') AS output FROM doc LEFT JOIN lab ON conv_id = doc_id",
    "c1_training_text": with_(D2, REPAIRED, formatted(True, MAPPING))
    + "SELECT id, preprocessed_input, output, text, schema_str FROM fmt",
    "c2_prepare": with_(D2, REPAIRED, formatted(False))
    + """SELECT id, input, output, preprocessed_input, text,
      CASE WHEN row_number() OVER (ORDER BY md5('1738:' || id), id) <= ceil(0.3::DOUBLE * count(*) OVER ())
      THEN 'eval' ELSE 'train' END AS split FROM fmt""",
    "c4_similarity_tfidf": with_(*D3F, BASIC, TFIDF)
    + """SELECT pair_id, round(any_value(jaccard_similarity), 6) AS jaccard_similarity,
      round(any_value(value_similarity)::DOUBLE, 6) AS value_similarity,
      round(avg(tfidf_cosine), 6) AS textual_similarity_tfidf FROM basic JOIN cosines USING (pair_id) GROUP BY pair_id""",
    "c6_decision_detail": with_(*D3F, SCORED, decided(0.8))
    + "SELECT pair_id, path, l_text, r_text, round(similarity, 6) AS similarity, decision FROM decided",
    "c6_decision_embedded": with_(
        *D3F, vectors(16),
        "lv AS (SELECT pair_id, left(label, -9) AS path, v FROM vecs WHERE side = 'Dict 1')",
        "rv AS (SELECT pair_id, left(label, -9) AS path, v FROM vecs WHERE side = 'Dict 2')",
        """scored AS (SELECT f.*, CASE WHEN l_text = r_text THEN 1.0::DOUBLE
           WHEN l_text <> r_text THEN list_dot_product(lv.v, rv.v)
             / (sqrt(list_dot_product(lv.v, lv.v)) * sqrt(list_dot_product(rv.v, rv.v))) END AS similarity
           FROM fields f LEFT JOIN lv USING (pair_id, path) LEFT JOIN rv USING (pair_id, path))""",
        decided(0.8),
    )
    + "SELECT pair_id, path, round(similarity, 6) AS similarity, decision FROM decided",
    "c6_nested_detail": with_(*D5F, SCORED, decided(0.8))
    + "SELECT pair_id, path, l_text, r_text, round(similarity, 6) AS similarity, decision FROM decided",
    "c7_nested_compare": with_(*D5F, BASIC, SCORED, decided(0.9), compared())
    + """SELECT pair_id, round(jaccard_similarity, 6) AS jaccard_similarity, round(value_similarity::DOUBLE, 6) AS value_similarity,
      round(similarity_score::DOUBLE, 6) AS similarity_score, round(weighted_mape::DOUBLE, 6) AS weighted_mape FROM compared""",
    "c7_compare": with_(*D3F, BASIC, SCORED, decided(0.9), compared())
    + """SELECT pair_id, round(jaccard_similarity, 6) AS jaccard_similarity, round(value_similarity::DOUBLE, 6) AS value_similarity,
      round(similarity_score::DOUBLE, 6) AS similarity_score, round(weighted_mape::DOUBLE, 6) AS weighted_mape FROM compared""",
    "c7_corpus": with_(*D3F, BASIC, SCORED, decided(0.9), compared())
    + """SELECT count(*) AS pairs, round(avg(jaccard_similarity), 6) AS jaccard_similarity,
      round(avg(value_similarity)::DOUBLE, 6) AS value_similarity, round(avg(similarity_score)::DOUBLE, 6) AS similarity_score,
      round(avg(weighted_mape)::DOUBLE, 6) AS weighted_mape FROM compared""",
    "training_pairs": f"""WITH p AS (
      SELECT doc_id AS id, text AS input, {ENTRY_JSON} AS output,
        '{{"lang":"str","quality":"' || CASE WHEN quality IS NULL THEN 'NoneType' ELSE 'int' END
          || '","source":"str","toxic":"' || CASE WHEN toxic IS NULL THEN 'NoneType' ELSE 'int' END || '"}}' AS schema_str
      FROM documents LEFT JOIN labels USING (doc_id)),
    q AS (SELECT *, {prompt("schema_str", "input", False)} AS preprocessed_input FROM p)
    SELECT id, input, preprocessed_input, output, {training_text("preprocessed_input", "output")} AS text FROM q""",
}

# D4 against D1: the parsed record takes the place of the changed copy of D3.
ORACLE_SQL["c9_evaluate"] = (
    with_(
        D4,
        CASCADE,
        "d3 AS (SELECT id AS pair_id, expected_json, coalesce(record, '{}') AS predicted_json FROM parsed)",
        FIELDS,
        BASIC,
        SCORED,
        decided(0.9),
        compared(),
    )
    + """SELECT pair_id AS id, round(jaccard_similarity, 6) AS jaccard_similarity, round(value_similarity::DOUBLE, 6) AS value_similarity,
      round(similarity_score::DOUBLE, 6) AS similarity_score, round(weighted_mape::DOUBLE, 6) AS weighted_mape FROM compared"""
)

for name, inside in (("w1_stop_first_bad", "w1_stop_inside"), ("w2_schema_carry", "w2_schema_carry_inside")):
    ORACLE_SQL[inside] = ORACLE_SQL[name].replace(D2, D2_LATE)

ORACLE_SQL["u2_embed_kept"] = ORACLE_SQL["u2_embed_distinct"]
ORACLE_SQL["u1_generate_kept"] = ORACLE_SQL["u1_batch_generate"]
ORACLE_SQL["u1_generate_unprompted"] = f"""SELECT doc_id, {prompt(f"'{SCHEMA_STR}'", "text", False)} AS preprocessed_input,
  'Sure: {{"chars": ' || length(text) || ', "limit": 50}}' AS generated_output FROM documents"""

ORACLE_SQL["a9_seq_percentiles"] = """WITH c AS (
    SELECT len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))::INTEGER AS n FROM documents WHERE text IS NOT NULL),
  r AS (SELECT n, row_number() OVER (ORDER BY n) AS place, count(*) OVER () AS total FROM c)
  SELECT p AS percentile, min(n) AS tokens, floor(1.1::DOUBLE * min(n))::INTEGER AS budget
  FROM r, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) v(p) WHERE place >= p * total GROUP BY p"""

# the query compares the sketch with the exact ranks itself; each must be within the stated error
ORACLE_SQL["a9_seq_sketch"] = """SELECT p AS percentile, count(text) > 0 AS within
  FROM documents, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) v(p) GROUP BY p"""

# every value of the tree of each record; a list index is no part of a path
ORACLE_SQL["a15_merged_schema"] = (
    with_(
        D5,
        f"""t AS (SELECT t.id = 0 AS is_root, t.type = 'OBJECT' AS is_dict,
          replace(ltrim(regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g')[2:], '.'), '.', ' ') AS path,
          replace(ltrim(regexp_replace(t.path, '\\[\\d+\\]', '[]', 'g')[2:], '.'), '.', ' ') AS parent,
          {type_of("t.value")} AS type FROM d3, json_tree(d3.predicted_json) t)""",
        "o AS (SELECT path AS parent, count(*) AS objects FROM t WHERE is_dict GROUP BY path)",
        """g AS (SELECT CASE WHEN path <> '' THEN parent END AS parent, path, list_sort(list(DISTINCT type)) AS types,
          count(*) AS occurrences, count(*) FILTER (type = 'NoneType') AS nulls FROM t GROUP BY ALL)""",
    )
    + """SELECT g.parent, path, CASE WHEN len(types) = 1 THEN types[1] WHEN types = ['float', 'int'] THEN 'float' ELSE 'any' END AS type,
      array_to_string(types, ',') AS types, occurrences, nulls::BIGINT AS nulls,
      coalesce(NOT ends_with(path, '[]') AND occurrences < objects, false) AS optional
    FROM g LEFT JOIN o USING (parent)"""
)
