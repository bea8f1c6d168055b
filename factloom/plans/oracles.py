"""The registered queries of the core in SQL."""

from __future__ import annotations

from factloom.functions.names import NO, YES
from factloom.functions.text import NO_TYPE
from factloom.operators.views import NOISE_CONTAINS, NOISE_EXACT, NOISE_OWNERS, NOISE_PREFIXES, OWNERLESS, OWNER_PREDICATES
from factloom.plans.reference import WIDTHS


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def address(x: str) -> str:
    digits = rf"regexp_extract(lower(regexp_replace({x}, '[\s`_]', '', 'g')), '^(?:0x)?0*([0-9a-f]+)h?$', 1)"
    return f"CASE WHEN {digits} <> '' THEN '0x' || {digits} END"


def subject(x: str) -> str:
    return f"coalesce({address(x)}, {squeeze(x)})"


def predicate(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({squeeze(x)}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[\s\-]+', '_', 'g'))"


OBS = f"""obs AS (SELECT DISTINCT id, {subject("subject")} AS subject, {predicate("predicate")} AS predicate, value, confidence, source, status, created_at, superseded_by FROM observations)"""
CALLS = f"""calls AS (SELECT DISTINCT subject AS src, {address("value")} AS dst FROM obs WHERE predicate = 'calls' AND {address("value")} IS NOT NULL)"""
HYP = f"""hyp AS (SELECT * REPLACE ({subject("subject")} AS subject) FROM (SELECT DISTINCT * FROM hypotheses))"""
INV = "inv AS (SELECT DISTINCT * FROM investigations)"
DEPS = """deps AS (SELECT DISTINCT source, target FROM (
  SELECT source, unnest(hypotheses_modified) AS target FROM (SELECT unnest(hypotheses_created) AS source, hypotheses_modified FROM inv)
  UNION ALL SELECT h.id, m.target FROM hyp h JOIN (SELECT id AS inv, unnest(hypotheses_modified) AS target FROM inv) m ON h.created_by = m.inv) WHERE source <> target)"""
NAMES = "names AS (SELECT subject, arg_max(value, id) AS name FROM obs WHERE predicate = 'has_name' AND value IS NOT NULL GROUP BY subject)"
OWNERS = f"""owned AS (SELECT subject, predicate, arg_max(value, id) AS owner FROM obs WHERE predicate IN ({quoted(OWNER_PREDICATES)}) AND value IS NOT NULL GROUP BY 1, 2),
owners AS (SELECT subject, coalesce({", ".join(f"max(owner) FILTER (predicate = '{p}')" for p in OWNER_PREDICATES)}) AS owner FROM owned GROUP BY 1)"""
RESERVED = lambda x: f"coalesce(regexp_matches({x}, '__|^_[A-Z]'), false)"
CLASSES = f"""cls AS (SELECT s.subject, CASE WHEN i.subject IS NOT NULL OR {RESERVED("o.owner")} OR {RESERVED("n.name")} THEN 'LIBRARY_OR_COMPILER' ELSE 'APPLICATION' END AS class
  FROM (SELECT DISTINCT subject FROM obs WHERE subject IS NOT NULL) s LEFT JOIN (SELECT DISTINCT subject FROM obs WHERE predicate = 'imports' AND value IS NOT NULL) i USING (subject)
  LEFT JOIN (SELECT subject, arg_max(value, id) AS owner FROM obs WHERE predicate IN ({quoted(OWNER_PREDICATES)}) AND value IS NOT NULL GROUP BY 1) o USING (subject) LEFT JOIN names n USING (subject))"""
_EITHER = lambda test: f"({test('name')} OR {test(chr(98) + 'are')})"
NOISE = f"""noise AS (SELECT subject, name, ({" OR ".join([_EITHER(lambda c: f"{c} IN ({quoted(NOISE_EXACT)})"), *(_EITHER(lambda c, p=p: f"starts_with({c}, '{p}')") for p in NOISE_PREFIXES), *(f"contains(name, '{x}')" for x in NOISE_CONTAINS)])})
  OR CASE WHEN owner IS NOT NULL THEN owner IN ({quoted(NOISE_OWNERS)}) ELSE name IN ({quoted(OWNERLESS)}) END AS noise
  FROM (SELECT n.subject, name, owner, regexp_replace(name, '^~', '') AS bare FROM names n LEFT JOIN owners USING (subject)))"""
FUNCTIONS = f"ff AS (SELECT *, {address('address')} AS subject FROM function_facts)"
ROLES = "roles AS (SELECT subject, arg_max(value, id) AS role, max(id) AS hypothesis_id FROM hyp WHERE status = 'ACCEPTED' AND predicate = 'semantic_role' AND trim(value) <> '' GROUP BY 1)"


def decoded(t: str) -> str:
    """SQL for ``4core3Foo``-like texts as rows can't loop: part after part is cut off, five times at most."""
    rest, parts = rf"regexp_replace({t}, '^N', '')", []
    for _ in range(5):
        n = rf"coalesce(try_cast(regexp_extract({rest}, '^(\d+)', 1) AS INT), 0)"
        body = rf"regexp_replace({rest}, '^\d+', '')"
        parts.append(f"nullif(substr({body}, 1, {n}), '')")
        rest = f"substr({body}, {n} + 1)"
    return f"concat_ws('::', {', '.join(parts[:3])})"


def class_cte(source: str, columns: dict[str, str], keep: str = "", name: str = "rc") -> str:
    """A CTE with canonical class names of the given columns."""
    clean = {c: rf"regexp_replace(regexp_replace(regexp_replace({squeeze(x)}, '^((class|struct|union|enum|public|protected|private|virtual|typename|const)\s+)+', ''), '\s*::\s*', '::', 'g'), '^(::)+', '')" for c, x in columns.items()}
    inner = ", ".join(f"{x} AS {c}" for c, x in clean.items())
    outer = ", ".join(rf"CASE WHEN regexp_matches({c}, '^N?\d+[A-Za-z_]') THEN {decoded(c)} WHEN {c} <> '' THEN {c} END AS {c}" for c in columns)
    return f"{name} AS (SELECT {outer}{keep} FROM (SELECT {inner}{keep} FROM {source}))"


RC = class_cte("recovered_classes", {"class_name": "name", "base": "base"}, ", methods, fields, class_refs, vtable_address")
SLOTS = f"""best AS (SELECT class_name, max(base) AS b, max(coalesce(len(methods), 0)) AS most FROM rc WHERE class_name IS NOT NULL GROUP BY 1),
slots AS (SELECT DISTINCT class_name, b AS base, slot, {address("m.address")} AS address FROM (
  SELECT rc.class_name, b, unnest(methods) AS m, generate_subscripts(methods, 1) - 1 AS slot FROM rc JOIN best ON rc.class_name = best.class_name AND coalesce(len(methods), 0) = most))"""
WORDS = lambda x: rf"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')))"
HEX = lambda x: f"('0x' || substr({x}, 3))::BIGINT"
FP = r"""CASE WHEN trim(decompilation) <> '' THEN md5(regexp_replace(decompilation, '\b([A-Za-z0-9_]*_)[0-9a-fA-F]{6,}\b', '\1<ADDR>', 'g')) END"""
REST = r"regexp_replace(substr(decompilation, nullif(instr(decompilation, '{'), 0)), '\s+$', '')"
STRIP = lambda x: rf"regexp_replace({x}, '(?s)//[^\n]*|/\*.*?(?:\*/|\z)', '', 'g')"
EMPTY = rf"""({REST} IS NULL OR {REST} IN ('{{...}}', '{{ ... }}') OR NOT regexp_matches({REST}, '(?s)^\{{.*\}}$')
  OR regexp_replace({STRIP(rf"regexp_extract({REST}, '(?s)^\{{(.*)\}}$', 1)")}, '\s+', '', 'g') = '')"""
PIECES = r"""regexp_extract_all({x}, '"(?:[^"]|"")*"|[0-9]+(?:''?\s*\([^()"]*\))?')"""
CITED = lambda field: rf"""(SELECT id, created_at, row_number() OVER (PARTITION BY id ORDER BY k) AS pos, n FROM (
    SELECT id, created_at, generate_subscripts(ps, 1) AS k, try_cast(regexp_extract(unnest(ps), '[0-9]+') AS BIGINT) AS n FROM (
      SELECT id, created_at, {PIECES.replace("{x}", field)} AS ps FROM (SELECT DISTINCT id, created_at, {field} FROM hypotheses) WHERE {field} IS NOT NULL)) WHERE n IS NOT NULL)"""  # noqa: E731
_INT = rf"CASE WHEN regexp_matches(trim(o), '^0[xX][0-9a-fA-F]{{1,15}}$') THEN ('0x' || substr(trim(o), 3))::BIGINT ELSE try_cast(trim(o) AS BIGINT) END"
FIELDS = f"flds AS (SELECT class_name, {_INT} AS o, unnest(ts) AS t FROM (SELECT class_name, f.field_offset AS o, f.candidate_types AS ts FROM (SELECT class_name, unnest(fields) AS f FROM rc)))"
REACH = lambda start, name="reach": f"{name} AS ({start} UNION SELECT dst FROM calls JOIN {name} ON src = node)"


def _with(*ctes: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(ctes) + "\n"


_DATA = {
    "data_symbol_name": "text", "data_section": "text", "data_type_name": "text", "data_readable": "flag", "data_writable": "flag", "data_executable": "flag",
    "data_initialized": "flag", "data_size_bytes": "size", "data_size_bytes_estimated": "size",
}
_V = squeeze("value")
_UNIT = rf"regexp_replace(lower({_V}), '^(\d[\d,]*|\d+\.0*)\s*(bytes?|b)$', '\1')"
_READ = {
    "text": f"nullif({_V}, '')",
    "flag": f"CASE WHEN lower({_V}) IN ({quoted(YES)}) THEN 1 WHEN lower({_V}) IN ({quoted(NO)}) THEN 0 END",
    "size": rf"""CASE WHEN regexp_matches(lower({_V}), '^0x[0-9a-f]{{1,15}}$') THEN lower({_V})::BIGINT
      WHEN regexp_matches({_UNIT}, '^(\d{{1,18}}|\d{{1,3}}(,\d{{3}})+)(\.0*)?$') THEN regexp_replace(regexp_replace({_UNIT}, '\.0*$', ''), ',', '', 'g')::BIGINT END""",
}
P5 = _with(OBS, "d AS (SELECT * FROM obs WHERE status = 'ACTIVE' AND subject IS NOT NULL AND predicate IN (" + quoted(_DATA) + "))") + (
    "SELECT subject, " + ", ".join(f"arg_max({_READ[k]}, id) FILTER (predicate = '{n}' AND ({_READ[k]}) IS NOT NULL)::{ {'text': 'VARCHAR', 'flag': 'INT', 'size': 'BIGINT'}[k] } AS {n}" for n, k in _DATA.items()) + " FROM d GROUP BY subject"
)
P2_CTES = (
    OBS,
    f"""refs AS (SELECT DISTINCT * FROM (
      SELECT 'observations' AS kind, observation_id AS key, id AS row_id, 'evidence' AS ref_table, 'observation_id' AS ref_field, recorded_at AS t FROM evidence
      UNION ALL SELECT 'evidence', n, id, 'hypotheses', 'supporting_evidence', created_at FROM {CITED("supporting_evidence")}
      UNION ALL SELECT 'investigations', created_by, id, 'hypotheses', 'created_by', created_at FROM hypotheses) WHERE key IS NOT NULL)""",
    """recs AS (SELECT kind, key, min(f) AS f, bool_and(coalesce(gone, false)) AS gone FROM (
      SELECT 'observations' AS kind, id AS key, created_at AS f, upper(trim(status)) = 'RETRACTED' AS gone FROM observations
      UNION ALL SELECT 'evidence', id, recorded_at, false FROM evidence UNION ALL SELECT 'investigations', id, created_at, false FROM investigations) GROUP BY 1, 2)""",
    """found AS (SELECT ref_table, ref_field, row_id, key AS ref_id, CASE WHEN gone IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN f > t THEN 'later' END AS state,
      strftime(t, '%Y-%m') AS ref_month FROM refs LEFT JOIN recs USING (kind, key))""",
)
_BELOW = class_cte("recovered_classes", {"name": "name", "base": "base"})

ROOTS = """roots AS (SELECT subject AS node FROM obs WHERE predicate = 'exports' AND value = 'entry' UNION
  SELECT src FROM calls WHERE src IS NOT NULL AND src NOT IN (SELECT dst FROM calls) AND NOT EXISTS (SELECT 1 FROM obs WHERE predicate = 'exports' AND value = 'entry'))"""
REACHED = "reached(node, depth) USING KEY (node) AS (SELECT node, 0 FROM roots UNION SELECT dst, min(depth) + 1 FROM reached JOIN calls ON src = node WHERE dst NOT IN (SELECT node FROM recurring.reached) GROUP BY 1)"
SOLE = "sole AS (SELECT src, min(dst) AS dst FROM calls GROUP BY 1 HAVING count(*) = 1)"
THIN = """sized AS (SELECT subject, try_cast(trim(arg_max(value, id)) AS BIGINT) AS size FROM obs WHERE predicate = 'size_bytes' AND value IS NOT NULL GROUP BY 1),
thin AS (SELECT src, dst FROM sole JOIN sized ON src = sized.subject WHERE size <= 32)"""
IMPORTED = "imp AS (SELECT DISTINCT subject AS node FROM obs WHERE predicate = 'imports' AND value IS NOT NULL)"
FORWARDING = "fwd(node, depth) USING KEY (node) AS (SELECT node, 0 FROM imp UNION SELECT src, min(depth) + 1 FROM fwd JOIN thin ON dst = node WHERE depth < 3 AND src NOT IN (SELECT node FROM recurring.fwd) GROUP BY 1)"
CHAINED = "chain(node, depth) USING KEY (node) AS (SELECT node, 0 FROM imp UNION SELECT src, min(depth) + 1 FROM chain JOIN sole ON dst = node WHERE depth < 5 AND src NOT IN (SELECT node FROM recurring.chain) GROUP BY 1)"


def slots(body: str, parameter: str) -> str:
    """How many different slots of the object in a parameter a body touches."""
    rest = rf"regexp_extract({body}, '(?s)(\{{.*)$', 1)"
    array = rf"list_transform(regexp_extract_all({rest}, {parameter} || '\[([^\]]*)\]', 1), lambda x: trim(x))"
    plus = rf"list_transform(regexp_extract_all({rest}, {parameter} || ' \+ ([0-9a-fA-Fx]+)', 1), lambda x: '+' || x)"
    star = rf"CASE WHEN regexp_matches({rest}, '\*' || {parameter} || '([^A-Za-z0-9_\[]|$)') THEN ['*'] ELSE [] END"
    return f"CASE WHEN {parameter} <> '' THEN len(list_distinct(list_concat(list_concat({array}, {plus}), {star}))) ELSE 0 END"


def first_parameter(body: str) -> str:
    inside = rf"regexp_extract({body}, '(?s)^[^{{(]*\(([^{{]*)\)[^{{)]*\{{', 1)"
    head = f"trim(string_split({inside}, ',')[1])"
    return f"CASE WHEN {head} NOT IN ('', 'void') THEN regexp_extract({head}, '([^ *]+)[ *]*$', 1) END"


_ROUND = lambda k: f"""v{k} AS (SELECT s.subject, s.first, coalesce(s.first, t.target, s.verdict, CASE WHEN m.share >= 0.8 THEN 'LIBRARY_OR_RUNTIME' WHEN m.direct THEN 'APPLICATION' END) AS verdict FROM v{k - 1} s
  LEFT JOIN (SELECT src, avg(CASE WHEN v.verdict = 'LIBRARY_OR_RUNTIME' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share, bool_or(coalesce(v.first = 'APPLICATION', false)) AS direct FROM calls LEFT JOIN v{k - 1} v ON v.subject = dst GROUP BY 1) m ON m.src = s.subject
  LEFT JOIN (SELECT thin.src, v.verdict AS target FROM thin JOIN v{k - 1} v ON v.subject = thin.dst) t ON t.src = s.subject)"""  # noqa: E731
PROVENANCE = [
    SOLE, THIN, IMPORTED, FORWARDING,
    "near AS (SELECT DISTINCT src AS subject FROM calls WHERE dst IN (SELECT node FROM fwd WHERE depth > 0))",
    f"bodies AS (SELECT subject, body, {first_parameter('body')} AS par FROM (SELECT subject, arg_max(value, id) AS body FROM obs WHERE predicate = 'decompiles_to' AND value IS NOT NULL GROUP BY 1))",
    f"slotted AS (SELECT subject, {slots('body', 'par')} AS n FROM bodies)",
    f"""own AS (SELECT subject, arg_max(value, id) AS owner FROM obs WHERE predicate IN ({quoted(OWNER_PREDICATES)}) AND value IS NOT NULL GROUP BY 1)""",
    f"""v0 AS (SELECT subject, verdict AS first, verdict FROM (SELECT c.subject, CASE WHEN class = 'LIBRARY_OR_COMPILER' THEN 'LIBRARY_OR_RUNTIME' WHEN own.owner IS NOT NULL AND NOT {RESERVED('own.owner')} THEN 'APPLICATION'
      WHEN slotted.n >= 2 AND near.subject IS NOT NULL THEN 'APPLICATION' END AS verdict FROM cls c LEFT JOIN own USING (subject) LEFT JOIN slotted USING (subject) LEFT JOIN near ON near.subject = c.subject))""",
    *(_ROUND(k) for k in range(1, 6)),
    "prov AS (SELECT subject, coalesce(verdict, 'UNKNOWN') AS provenance FROM v5)",
]
_LINES = "string_split(inner_text, chr(10))"
_DECLARED = r"^\s*[^=(,;]*?([\w\[\]:<>&]+)\s*(?:\*\s*)+([A-Za-z_]\w*)\s*;\s*$"
#: Whether a body is degenerate: empty, or a local pointer in it is read and never assigned.
DEGENERATE = rf"""({EMPTY} OR len(list_filter(list_distinct(list_transform(list_filter({_LINES}, lambda x: regexp_extract(x, '{_DECLARED}', 2) <> '' AND regexp_extract(x, '{_DECLARED}', 1) NOT IN ({quoted(NO_TYPE)})),
  lambda x: regexp_extract(x, '{_DECLARED}', 2))), lambda n:
  len(list_filter({_LINES}, lambda x: (NOT regexp_matches(x, '\*\s*' || n || '\s*;\s*$') OR regexp_matches(x, '[=(,]')) AND (regexp_matches(x, '\*\s*' || n || '(\W|$)') OR regexp_matches(x, '(^|\W)' || n || '->')))) > 0
  AND len(list_filter({_LINES}, lambda x: (NOT regexp_matches(x, '\*\s*' || n || '\s*;\s*$') OR regexp_matches(x, '[=(,]')) AND regexp_matches(x, '(^\s*|[^*\s]\s+|[^*\s\w])' || n || '\s*=([^=]|$)'))) = 0)) > 0)"""
BODIES = rf"""judged AS (SELECT *, {DEGENERATE} AS degenerate FROM (SELECT *, regexp_extract({REST}, '(?s)^\{{(.*)\}}$', 1) AS inner_text FROM ff WHERE decompilation IS NOT NULL))"""

_SIZED = """sized_data AS (SELECT subject, try_cast(n AS BIGINT) AS size_bytes, bytes_hex FROM (SELECT subject, max(v) FILTER (predicate = 'data_size_bytes') AS n, max(v) FILTER (predicate = 'data_bytes_hex') AS bytes_hex,
  max(v) FILTER (predicate = 'data_section') AS s, max(v) FILTER (predicate = 'data_executable') AS x, max(v) FILTER (predicate = 'data_type_name') AS t FROM l GROUP BY 1)
  WHERE NOT coalesce(x = 'true' AND s = '.text', false) AND coalesce(t, '') <> 'undefined' AND regexp_matches(n, '^[+]?[0-9]+$') AND try_cast(n AS BIGINT) IS NOT NULL)"""

ORACLES: dict[str, str] = {
    "p2_found": _with(*P2_CTES) + "SELECT * FROM found WHERE state IS NOT NULL",
    "p2_report": _with(*P2_CTES) + "SELECT ref_table, ref_field, ref_month, state, count(*) AS n_references, count(DISTINCT row_id) AS n_rows FROM found WHERE state IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p5_found": P5,
    "p7_found": f"""SELECT id AS hypothesis_id, 'supporting_evidence' AS field_name, pos::INT AS pos, n AS evidence_id FROM {CITED("supporting_evidence")}
      UNION ALL SELECT id, 'contradicting_evidence', pos::INT, n FROM {CITED("contradicting_evidence")}""",
    "p4_found": _with(
        _BELOW,
        "own AS (SELECT name, max(base) AS base FROM rc WHERE name IS NOT NULL GROUP BY 1)",
        # every ancestor with its steps; a walk ends where it would come to a class again
        "up AS (SELECT name, name AS anc, [name] AS way, base AS nxt FROM own UNION ALL SELECT up.name, up.nxt, list_append(way, up.nxt), o.base FROM up LEFT JOIN own o ON o.name = up.nxt WHERE up.nxt IS NOT NULL AND NOT list_contains(way, up.nxt))",
        "fin AS (SELECT name, way, anc, CASE WHEN nxt IS NULL THEN len(way) ELSE list_position(way, nxt) END AS k, nxt FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY len(way) DESC) AS nth FROM up) WHERE nth = 1)",
        "below AS (SELECT anc AS name, count(*) - 1 AS n FROM up GROUP BY 1)",
        recursive=True,
    )
    + """SELECT fin.name AS class_name, CASE WHEN nxt IS NULL THEN anc ELSE list_min(way[k:]) END AS root_name, (CASE WHEN nxt IS NULL THEN len(way) - 1 ELSE k - 1 END)::INT AS depth,
      CASE WHEN nxt IS NULL THEN 'tree' WHEN k = 1 THEN 'cycle' ELSE 'below_cycle' END AS state,
      array_to_string(list_reverse(way[1:k]), ' > ') AS full_path, n::INT AS n_descendants FROM fin JOIN below USING (name)""",
    "f3_live_facts": _with(OBS) + "SELECT predicate, count(*) AS n_facts, count(DISTINCT subject) AS n_subjects FROM obs WHERE status = 'ACTIVE' GROUP BY 1",
    "f4_latest_values": _with(OBS) + "SELECT subject, predicate, arg_max(value, id) AS value, max(id) AS id FROM obs WHERE value IS NOT NULL GROUP BY 1, 2",
    "f9_empty_bodies": f"SELECT fact_id, length(decompilation)::INT AS n_chars FROM function_facts WHERE decompilation IS NOT NULL AND {EMPTY}",
    "f12_reserved_names": _with(OBS) + f"SELECT predicate, value, count(DISTINCT subject) AS n_subjects FROM obs WHERE predicate IN ('has_name', 'is_method_of') AND {RESERVED('value')} GROUP BY 1, 2",
    "f13_subject_classes": _with(OBS, NAMES, CLASSES) + "SELECT subject, class FROM cls",
    "f15_owners": _with(OBS, OWNERS) + "SELECT subject, owner FROM owners",
    "f16_noise": _with(OBS, NAMES, OWNERS, NOISE) + "SELECT subject, name, noise FROM noise",
    "f22_accepted_names": _with(HYP, ROLES) + "SELECT subject, role, hypothesis_id FROM roles",
    "f25_labels": _with(OBS, HYP, NAMES) + """SELECT subject, coalesce(role, does, CASE WHEN NOT starts_with(name, 'FUN_') THEN name END) AS label,
      CASE WHEN role IS NOT NULL THEN 'role' WHEN does IS NOT NULL THEN 'mechanics' WHEN NOT starts_with(name, 'FUN_') THEN 'name' ELSE 'none' END AS label_kind FROM names
      LEFT JOIN (SELECT subject, arg_max(value, id) AS role FROM hyp WHERE status = 'ACCEPTED' AND predicate = 'semantic_role' AND value IS NOT NULL GROUP BY 1) USING (subject)
      LEFT JOIN (SELECT subject, arg_max(value, id) AS does FROM hyp WHERE status = 'ACCEPTED' AND predicate = 'mechanical_behavior' AND value IS NOT NULL GROUP BY 1) USING (subject)""",
    "f27_symbol_addresses": _with(OBS, f"s AS (SELECT DISTINCT {squeeze('value')} AS symbol FROM obs WHERE predicate = 'data_symbol_name')")
    + "SELECT symbol, '0x' || lower(h) AS address FROM (SELECT symbol, list_filter(string_split(symbol, '_'), lambda x: regexp_matches(x, '^[0-9a-fA-F]+$'))[-1] AS h FROM s WHERE symbol <> '') WHERE regexp_matches(h, '[a-fA-F]') OR length(h) >= 6",
    "f28_sized_data": _with(OBS, f"l AS (SELECT subject, predicate, {squeeze('arg_max(value, id)')} AS v FROM obs WHERE value IS NOT NULL GROUP BY 1, 2)", _SIZED)
    + "SELECT subject, size_bytes, bytes_hex FROM sized_data",
    "f28_confident_data": _with(OBS, f"l AS (SELECT subject, predicate, {squeeze('arg_max(value, id)')} AS v FROM obs WHERE value IS NOT NULL GROUP BY 1, 2)", _SIZED)
    + "SELECT subject, size_bytes, bytes_hex FROM sized_data WHERE len(bytes_hex) % 2 = 0 AND NOT regexp_matches(bytes_hex, '[^0-9a-fA-F]')",
    "f30_known_callees": _with(OBS, CALLS) + """SELECT dst AS subject, count(*) AS n_callers, dst IN (SELECT subject FROM obs WHERE predicate = 'calling_convention' AND value IS NOT NULL AND subject IS NOT NULL) AS is_function,
      dst IN (SELECT subject FROM obs WHERE predicate = 'imports' AND value IS NOT NULL AND subject IS NOT NULL) AS is_import FROM calls GROUP BY dst""",
    "j1_evidence": _with(OBS) + f"""SELECT c.id AS hypothesis_id, c.pos::INT AS pos, c.n AS evidence_id, e.observation_id, o.subject, o.predicate FROM {CITED("supporting_evidence")} c
      JOIN (SELECT DISTINCT id, observation_id FROM evidence) e ON c.n = e.id JOIN obs o ON o.id = e.observation_id""",
    "j2_seeds": _with(OBS, HYP, NAMES, OWNERS, NOISE) + "SELECT subject, name FROM noise WHERE NOT noise AND NOT EXISTS (SELECT 1 FROM hyp WHERE hyp.subject = noise.subject)",
    "j3_fingerprint_reuse": _with(FUNCTIONS, HYP, ROLES, f"f AS (SELECT subject, arg_max(fp, fact_id) AS fp FROM (SELECT subject, fact_id, {FP} AS fp FROM ff) WHERE fp IS NOT NULL AND subject IS NOT NULL GROUP BY 1)")
    + "SELECT f.subject, k.s AS source_subject, k.r AS role FROM f JOIN (SELECT fp, min(subject) AS s, arg_min(role, subject) AS r FROM f JOIN roles USING (subject) GROUP BY 1) k USING (fp) WHERE f.subject NOT IN (SELECT subject FROM roles)",
    "j4_sibling_slots": _with(RC, SLOTS) + "SELECT base, slot::INT AS slot, count(DISTINCT class_name) AS n_classes, min(class_name) AS first_class FROM slots WHERE base IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT class_name) > 1",
    "j5_sibling_roles": _with(RC, SLOTS, HYP, ROLES) + """SELECT s.class_name, s.slot::INT AS slot, s.address, g.c AS from_class, g.r AS role FROM slots s
      JOIN (SELECT base, slot, min({'c': class_name, 'r': role}) AS g FROM slots JOIN roles ON address = subject WHERE base IS NOT NULL GROUP BY 1, 2) USING (base, slot)
      WHERE s.address IS NOT NULL AND s.address NOT IN (SELECT subject FROM roles)""",
    "j6_supersessions": _with(OBS) + "SELECT id, superseded_by, newest_id FROM obs JOIN (SELECT subject, predicate, max(id) AS newest_id FROM obs WHERE status = 'ACTIVE' GROUP BY 1, 2) USING (subject, predicate) WHERE status = 'SUPERSEDED'",
    "j8_restated_roles": _with(HYP, f"w AS (SELECT id, subject, predicate, {WORDS('value')} AS ws FROM hyp)")
    + "SELECT DISTINCT a.id AS hypothesis_id, a.subject FROM w a JOIN w b ON a.subject = b.subject AND a.predicate = 'semantic_role' AND b.predicate = 'mechanical_behavior' WHERE len(a.ws) > 0 AND len(list_filter(a.ws, lambda x: NOT list_contains(b.ws, x))) = 0",
    "j9_call_neighbours": """WITH c AS (SELECT fact_id, (generate_subscripts(l, 1) - 1)::INT AS pos, '0x' || lower(unnest(l)) AS callee FROM (SELECT fact_id, regexp_extract_all(decompilation, 'FUN_([0-9A-Fa-f]+)', 1) AS l FROM function_facts)),
      n AS (SELECT *, list(callee) OVER (PARTITION BY fact_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM c)
      SELECT fact_id, pos, callee, array_to_string(near, ',') AS neighbours, (len(near) - 1)::INT AS n_neighbours FROM n""",
    "j11_vfunc0": _with(RC) + f"""SELECT DISTINCT class_name, v AS vtable, '0x' || to_hex({HEX("v")} + 16).lower() AS vfunc0 FROM (SELECT class_name, {address("vtable_address")} AS v FROM rc) WHERE v IS NOT NULL AND class_name IS NOT NULL""",
    "j18_sole_owners": _with(OBS) + f"SELECT subject, min(value) AS owner FROM obs WHERE predicate IN ({quoted(OWNER_PREDICATES)}) AND value IS NOT NULL GROUP BY 1 HAVING min(value) = max(value)",
    "j19_outcomes": _with(HYP, INV) + "SELECT inv.id, inv.task, coalesce(n, 0) AS n_hypotheses, first_id, n IS NULL AS missing FROM inv LEFT JOIN (SELECT created_by, count(*) AS n, min(id) AS first_id FROM hyp GROUP BY 1) ON created_by = inv.id",
    "j23_new_inheritance": _with(
        "i AS (SELECT DISTINCT unnest(from_json(json_extract(payload, '$.inheritance'), '[{\"derived\":\"VARCHAR\",\"base\":\"VARCHAR\"}]')) AS i FROM (SELECT payload FROM fact_documents WHERE json_valid(payload)))",
        class_cte("(SELECT i.derived AS derived, i.base AS base FROM i)", {"derived": "derived", "base": "base"}, name="p"), _BELOW,
    ) + "SELECT DISTINCT derived, base FROM p WHERE derived IS NOT NULL AND base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.name = p.derived AND rc.base = p.base)",
    "j24_class_references": _with(RC, class_cte("(SELECT class_name, base, unnest(class_refs) AS ref FROM rc)", {"class_name": "class_name", "base": "base", "ref": "ref"}, name="r"))
    + "SELECT DISTINCT class_name, ref FROM r WHERE ref <> class_name AND (base IS NULL OR ref <> base) AND ref IN (SELECT class_name FROM rc WHERE class_name IS NOT NULL)",
    "a1_investigation_report": _with(HYP, INV, "won AS (SELECT task, count(*) AS won FROM (SELECT task, unnest(hypotheses_created) AS h FROM inv) WHERE h IN (SELECT id FROM hyp WHERE status = 'ACCEPTED') GROUP BY 1)")
    + """, per AS (SELECT task, count(*) AS executed, sum(coalesce(len(hypotheses_created), 0))::BIGINT AS hypotheses_created, sum(coalesce(len(hypotheses_modified), 0))::BIGINT AS hypotheses_modified,
      sum(coalesce(len(evidence_created), 0))::BIGINT AS evidence_created, count(*) FILTER (task <> 'ResolveContradiction' AND coalesce(len(hypotheses_created), 0) = 0 AND coalesce(len(evidence_created), 0) = 0) AS no_op FROM inv GROUP BY 1)
      SELECT per.*, coalesce(won, 0) AS accepted_from_created, executed - no_op AS productive, round((executed - no_op) / executed, 6) AS productive_rate FROM per LEFT JOIN won USING (task)""".replace(", per AS", "SELECT * FROM (WITH per AS", 1) + ")",
    "a5_library_ratio": _with(OBS, CALLS, NAMES, CLASSES) + "SELECT src AS subject, count(*) AS n_callees, round(avg(CASE WHEN class = 'LIBRARY_OR_COMPILER' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS library_ratio FROM calls LEFT JOIN cls ON dst = subject GROUP BY src",
    "a6_dependents": _with(HYP, INV, DEPS) + "SELECT target AS hypothesis_id, count(*) AS n_dependents FROM deps GROUP BY 1",
    "a7_attempts": _with(INV) + f"SELECT coalesce({address('target')}, target) AS subject, count(*) AS n_attempts FROM inv WHERE task = 'AnalyzeFunction' GROUP BY 1",
    "a8_coverage": _with(HYP) + """SELECT coalesce(won, false) OR NOT coalesce(waits, false) AS resolved, count(*) AS n_subjects FROM (SELECT subject, bool_or(status = 'ACCEPTED') AS won,
      bool_or((status = 'PROPOSED' AND last_verified_at IS NULL) OR status IN ('INVESTIGATING', 'CONTESTED')) AS waits FROM hyp GROUP BY 1) GROUP BY 1""",
    "a10_statuses": _with(HYP) + "SELECT predicate, status, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM hyp GROUP BY 1, 2",
    "a12_sole_callees": _with(OBS, CALLS) + "SELECT src AS subject, min(dst) AS callee FROM calls GROUP BY 1 HAVING count(*) = 1",
    "a13_thunks": _with(OBS, CALLS, "sz AS (SELECT subject, try_cast(trim(arg_max(value, id)) AS BIGINT) AS size FROM obs WHERE predicate = 'size_bytes' AND value IS NOT NULL GROUP BY 1)")
    + "SELECT src AS subject, min(dst) AS target FROM calls JOIN sz ON src = sz.subject WHERE size <= 32 GROUP BY 1 HAVING count(*) = 1",
    "a14_name_collisions": _with(FUNCTIONS) + r"""SELECT subject, name, params, n, name || '_' || substr(subject, 3) AS distinct_name FROM (SELECT *, count(*) OVER (PARTITION BY name, params) AS n FROM (
      SELECT DISTINCT subject, name, coalesce(regexp_extract(signature, '\((.*)\)', 1), '') AS params FROM ff WHERE name IS NOT NULL AND subject IS NOT NULL)) WHERE n > 1""",
    "a16_field_candidates": _with(RC, FIELDS) + "SELECT class_name, o AS field_offset, array_to_string(list_sort(list(DISTINCT t)), ',') AS types, count(DISTINCT t) AS n_types FROM flds WHERE o IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2",
    "a17_extents": _with(RC, FIELDS, f"sp AS (SELECT DISTINCT class_name, o, CASE {' '.join(f'WHEN t = {chr(39)}{k}{chr(39)} THEN {v}' for k, v in WIDTHS.items())} END AS w FROM flds)")
    + "SELECT class_name, max(e)::BIGINT AS extent FROM (SELECT class_name, o + w AS e FROM sp WHERE o IS NOT NULL AND w IS NOT NULL UNION ALL SELECT a.class_name, a.o + 24 FROM sp a JOIN sp b ON a.class_name = b.class_name AND b.o = a.o + 8 WHERE a.w = 8 AND b.w = 8) GROUP BY 1",
    "g1_stale_cascade": _with(HYP, INV, DEPS, "hit AS (SELECT id FROM hyp WHERE status = 'REJECTED' UNION SELECT source FROM deps JOIN hit ON target = id)", recursive=True)
    + "SELECT id FROM hit JOIN hyp USING (id) WHERE status NOT IN ('REJECTED', 'STALE')",
    "g10_import_chains": _with(OBS, CALLS, "sole AS (SELECT src, min(dst) AS dst FROM calls GROUP BY 1 HAVING count(*) = 1)", "imp AS (SELECT DISTINCT subject AS node FROM obs WHERE predicate = 'imports' AND value IS NOT NULL)",
        "back AS (SELECT node, 0 AS d FROM imp UNION SELECT src, d + 1 FROM sole JOIN back ON dst = node WHERE d < 5)", recursive=True) + "SELECT DISTINCT node AS subject FROM back WHERE d > 0 AND node NOT IN (SELECT node FROM imp)",
    "g2_reachable": _with(OBS, CALLS, ROOTS, REACHED, recursive=True) + "SELECT node AS subject, depth::INT AS depth FROM reached",
    "g4_api_hints": _with(OBS, CALLS, NAMES, ROOTS, REACHED, recursive=True)
    + "SELECT name, min(depth)::INT AS depth FROM reached JOIN names ON node = subject WHERE depth BETWEEN 1 AND 3 AND NOT starts_with(name, 'FUN_') GROUP BY 1",
    "s10_linker_symbols": r"""SELECT symbol, CASE WHEN a <> '' THEN 'FUNCTION' ELSE 'DATA' END AS kind, CASE WHEN a <> '' THEN '0x' || lower(a) END AS address, n_logs, first_doc FROM (
      SELECT symbol, regexp_extract(symbol, '^(?:thunk_)?FUN_([0-9A-Fa-f]+)$', 1) AS a, count(DISTINCT doc_id) AS n_logs, min(doc_id) AS first_doc FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, 'undefined reference to `([^''(]+)', 1)) AS symbol FROM documents WHERE doc_type = 'link_log') GROUP BY 1)""",
    "m22_retries": _with(HYP, INV, f"att AS (SELECT coalesce({address('target')}, target) AS subject, count(*) AS n FROM inv WHERE task = 'AnalyzeFunction' GROUP BY 1)")
    + "SELECT subject, coalesce(n, 0) AS n_attempts FROM (SELECT DISTINCT subject FROM hyp WHERE status = 'REJECTED') LEFT JOIN att USING (subject) WHERE coalesce(n, 0) < 3",
    "c1_contexts": _with(OBS, HYP) + """SELECT subject, n_hypotheses, n_reasons, statuses, coalesce(n_facts, 0) AS n_facts, coalesce(n_predicates, 0) AS n_predicates FROM (SELECT subject, count(*) AS n_hypotheses, count(rejection_reason) AS n_reasons,
      array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses FROM hyp GROUP BY 1) LEFT JOIN (SELECT subject, count(*) AS n_facts, count(DISTINCT predicate) AS n_predicates FROM obs WHERE predicate <> 'agent_flagged_contradiction' GROUP BY 1) USING (subject)""",
    "t1_fingerprints": f"SELECT fp, count(*) AS n_functions, min(fact_id) AS first_fact FROM (SELECT fact_id, {FP} AS fp FROM function_facts) WHERE fp IS NOT NULL GROUP BY 1",
    "t4_words": _with(HYP) + f"SELECT word, count(*) AS n_hypotheses FROM (SELECT id, unnest({WORDS('value')}) AS word FROM hyp) GROUP BY 1",
    "t10_data_references": r"SELECT fact_id, unnest(list_distinct(list_filter(regexp_split_to_array(decompilation, '[^A-Za-z0-9_]+'), lambda x: (starts_with(x, 'DAT_') OR starts_with(x, 'PTR_')) AND length(x) > 4))) AS symbol FROM function_facts",
    "t11_calls_in_order": "SELECT fact_id, (generate_subscripts(l, 1) - 1)::INT AS pos, '0x' || lower(unnest(l)) AS callee FROM (SELECT fact_id, regexp_extract_all(decompilation, 'FUN_([0-9A-Fa-f]+)', 1) AS l FROM function_facts)",
    "t26_comments": f"SELECT * FROM (SELECT fact_id, length(decompilation)::INT AS n_chars, length({STRIP('decompilation')})::INT AS n_code FROM function_facts WHERE decompilation IS NOT NULL) WHERE n_code < n_chars",
    "t27_literals": r"SELECT t::BIGINT AS value, count(*) AS n, count(DISTINCT fact_id) AS n_functions FROM (SELECT fact_id, unnest(list_filter(regexp_split_to_array(decompilation, '[^A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^0x[0-9a-fA-F]+$'))) AS t FROM function_facts) GROUP BY 1",
    "t38_field_accesses": r"""SELECT fact_id, count(*) AS n_fields, max(t) AS last_offset FROM (SELECT fact_id, unnest(list_distinct(regexp_extract_all(decompilation, '\*\([a-z0-9]+ \*\)\(param_[0-9]+ \+ (0x[0-9a-f]+)\)', 1)))::BIGINT AS t FROM function_facts) WHERE t <> 0 GROUP BY 1""",
    "f1_ingest": _with(OBS, FUNCTIONS, """t AS (SELECT subject, 'has_name' AS predicate, name AS value, 'ghidra:function' AS source FROM ff UNION ALL SELECT subject, 'has_signature', signature, 'ghidra:function' FROM ff
      UNION ALL SELECT subject, 'calling_convention', calling_convention, 'ghidra:function' FROM ff UNION ALL SELECT subject, 'size_bytes', size::VARCHAR, 'ghidra:function' FROM ff
      UNION ALL SELECT subject, 'decompiles_to', nullif(decompilation, ''), 'ghidra:decompiler' FROM ff UNION ALL SELECT subject, 'is_method_of', owner_class, 'ghidra:function' FROM ff
      UNION ALL SELECT subject, 'is_constructor_of', CASE WHEN is_constructor THEN owner_class END, 'ghidra:function' FROM ff UNION ALL SELECT subject, 'is_destructor_of', CASE WHEN is_destructor THEN owner_class END, 'ghidra:function' FROM ff
      UNION ALL SELECT subject, 'calls', ADDR, 'ghidra:call_graph' FROM (SELECT subject, unnest(callees) AS c FROM ff) UNION ALL SELECT subject, 'called_by', ADDR, 'ghidra:call_graph' FROM (SELECT subject, unnest(callers) AS c FROM ff))""".replace("ADDR", address("c")))
    + """SELECT subject, predicate, value, 0.95::DOUBLE AS confidence, source, (SELECT max(id) FROM observations) + row_number() OVER (ORDER BY subject, predicate, value) AS new_id FROM (
      SELECT subject, predicate, value, max(source) AS source FROM t WHERE value IS NOT NULL AND subject IS NOT NULL GROUP BY 1, 2, 3) n WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.subject = n.subject AND o.predicate = n.predicate AND o.value = n.value)""",
}
_SCORED = _with(OBS, HYP, INV, DEPS, NAMES, OWNERS, NOISE, """dn AS (SELECT target AS id, count(*) AS n FROM deps GROUP BY 1)""", """sc AS (SELECT CASE WHEN status = 'CONTESTED' THEN 'ResolveContradiction' ELSE 'ChallengeHypothesis' END AS task, 'H' || id AS target,
  round(CASE WHEN status = 'CONTESTED' THEN 0.9::DOUBLE + coalesce(n, 0) * 0.05::DOUBLE ELSE 0.6::DOUBLE + coalesce(confidence, 0.0) * 0.3::DOUBLE + coalesce(n, 0) * 0.05::DOUBLE END, 6) AS score FROM hyp LEFT JOIN dn USING (id) WHERE status IN ('PROPOSED', 'INVESTIGATING', 'SUPPORTED', 'STALE', 'CONTESTED')
  UNION ALL SELECT 'AnalyzeFunction', subject, 0.5::DOUBLE FROM noise WHERE NOT noise AND NOT EXISTS (SELECT 1 FROM hyp WHERE hyp.subject = noise.subject))""")
ORACLES["k1_priorities"] = _SCORED + "SELECT task, target, score FROM sc"
ORACLES["k4_wave"] = _SCORED + "SELECT task, target, score, ((row_number() OVER (PARTITION BY task ORDER BY score DESC, target) - 1) // 5)::BIGINT AS cluster FROM (SELECT * FROM sc ORDER BY score DESC, task, target LIMIT 16)"


def _json_address(j: str) -> str:
    """The address in a JSON text, number, or object with one of both."""
    flat = lambda x: f"CASE json_type({x}) WHEN 'VARCHAR' THEN {address(f'({x} ->> {chr(39)}${chr(39)})')} WHEN 'UBIGINT' THEN '0x' || lower(to_hex({x}::BIGINT)) END"
    inner = f"json_extract({j}, '$.address')"
    return f"coalesce({flat(j)}, {flat(inner)}, {flat(f'json_extract({inner}, {chr(39)}$.offset{chr(39)})')}, {flat(f'json_extract({j}, {chr(39)}$.offset{chr(39)})')})"


def _links(side: str) -> str:
    return f"""SELECT snapshot_id, fp, f, '{side}' AS side, generate_subscripts(l, 1) - 1 AS lp, unnest(l) AS x FROM (SELECT snapshot_id, fp, f,
      CASE json_type(json_extract(f, '$.{side}s')) WHEN 'ARRAY' THEN json_extract(f, '$.{side}s[*]') WHEN 'NULL' THEN [] ELSE [json_extract(f, '$.{side}s')] END AS l FROM fs WHERE json_type(json_extract(f, '$.{side}s')) IS NOT NULL)"""


ORACLES["p6_found"] = _with(
    "docs AS (SELECT DISTINCT snapshot_id, payload FROM fact_documents WHERE json_valid(payload))",
    "fs AS (SELECT snapshot_id, generate_subscripts(l, 1) - 1 AS fp, unnest(l) AS f FROM (SELECT snapshot_id, json_extract(payload, '$.functions[*]') AS l FROM docs))",
    f"links AS ({_links('caller')} UNION ALL {_links('callee')})",
) + f"""SELECT snapshot_id, fp::INT AS function_pos, {_json_address("f")} AS function_address, side AS link_side, lp::INT AS link_pos, {_json_address("x")} AS link_address FROM links WHERE json_type(x) <> 'NULL'"""


STARTUP = [
    "entry AS (SELECT min(node) AS node FROM roots)",
    "siblings AS (SELECT DISTINCT c.dst AS node FROM calls c JOIN sole ON sole.dst = c.src JOIN entry ON sole.src = entry.node)",
    "walked AS (SELECT node AS root, node FROM siblings UNION SELECT root, dst FROM walked JOIN calls ON src = node)",
    "ranked AS (SELECT root, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, root DESC) AS k FROM walked GROUP BY 1)",
    "main AS (SELECT a.root FROM ranked a JOIN ranked b ON a.k = 1 AND b.k = 2 WHERE a.n >= 3 * b.n)",
    "from_entry AS (SELECT node FROM entry WHERE node IS NOT NULL UNION SELECT dst FROM from_entry JOIN calls ON src = node)",
    "startup AS (SELECT node FROM from_entry WHERE EXISTS (SELECT 1 FROM main) AND node NOT IN (SELECT node FROM walked JOIN main USING (root)))",
]
_ALL = (OBS, CALLS, NAMES, CLASSES, ROOTS, REACHED, *PROVENANCE, CHAINED, *STARTUP, FUNCTIONS, BODIES)
_DISPOSED = """disposed AS (SELECT subject, n_callers, CASE WHEN r.node IS NULL THEN 'UNREACHABLE' WHEN s.node IS NOT NULL THEN 'RUNTIME_ARTIFACT' WHEN provenance = 'APPLICATION' THEN 'REQUIRED_APPLICATION'
  WHEN coalesce(provenance, 'UNKNOWN') = 'UNKNOWN' THEN CASE WHEN body THEN 'REQUIRED_UNKNOWN' ELSE 'DEFERRED' END WHEN body THEN 'REQUIRED_RUNTIME_BODY' WHEN c.node IS NOT NULL THEN 'EXTERNAL_LIBRARY' ELSE 'COMPILER_RUNTIME' END AS disposition
  FROM (SELECT dst AS subject, count(*) AS n_callers FROM calls GROUP BY 1) LEFT JOIN reached r ON r.node = subject LEFT JOIN startup s ON s.node = subject LEFT JOIN prov USING (subject)
  LEFT JOIN (SELECT subject, bool_or(NOT degenerate) AS body FROM judged GROUP BY 1) USING (subject) LEFT JOIN (SELECT node FROM chain WHERE depth > 0) c ON c.node = subject)"""
_HIERARCHY = [
    _BELOW.replace("rc AS", "lk AS", 1), "up_own AS (SELECT name, max(base) AS base FROM lk WHERE name IS NOT NULL GROUP BY 1)",
    "up AS (SELECT name, [name] AS way, base AS nxt FROM up_own UNION ALL SELECT up.name, list_append(way, up.nxt), o.base FROM up LEFT JOIN up_own o ON o.name = up.nxt WHERE up.nxt IS NOT NULL AND NOT list_contains(way, up.nxt))",
    "rooted AS (SELECT name AS class_name, CASE WHEN nxt IS NULL THEN way[-1] ELSE list_min(way[list_position(way, nxt):]) END AS root FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY len(way) DESC) AS k FROM up) WHERE k = 1)",
    RC, SLOTS, "rs AS (SELECT slots.*, root FROM slots JOIN rooted USING (class_name))",
]
ORACLES |= {
    "j4_hierarchy_slots": _with(*_HIERARCHY, recursive=True) + "SELECT root, slot::INT AS slot, count(DISTINCT class_name) AS n_classes, min(class_name) AS first_class FROM rs GROUP BY 1, 2 HAVING count(DISTINCT class_name) > 1",
    "j5_hierarchy_roles": _with(*_HIERARCHY, HYP, ROLES, recursive=True) + """SELECT s.class_name, s.slot::INT AS slot, s.address, g.c AS from_class, g.r AS role FROM rs s
      JOIN (SELECT root, slot, min({'c': class_name, 'r': role}) AS g FROM rs JOIN roles ON address = subject GROUP BY 1, 2) USING (root, slot) WHERE s.address IS NOT NULL AND s.address NOT IN (SELECT subject FROM roles)""",
    "f8_substantive_bodies": _with(FUNCTIONS, BODIES) + """SELECT program, subject, arg_max(fact_id, {'g': NOT degenerate, 'e': coalesce(extracted_at, TIMESTAMP '0001-01-01'), 'f': fact_id}) AS fact_id, bool_or(NOT degenerate) AS substantive FROM judged GROUP BY 1, 2""",
    "g5_provenance": _with(OBS, CALLS, NAMES, CLASSES, *PROVENANCE, recursive=True) + "SELECT subject, provenance FROM prov",
    "a4_claim_breakdown": _with(OBS, CALLS, NAMES, CLASSES, *PROVENANCE, HYP, recursive=True)
    + "SELECT coalesce(provenance, 'UNKNOWN') AS provenance, count(*) AS n_claims FROM hyp LEFT JOIN prov USING (subject) WHERE status = 'ACCEPTED' AND predicate = 'semantic_role' GROUP BY 1",
    "g16_frontier": _with(OBS, CALLS, NAMES, CLASSES, ROOTS, REACHED, *PROVENANCE, recursive=True)
    + """SELECT subject, r.node IS NOT NULL AS reachable, CASE WHEN provenance = 'LIBRARY_OR_RUNTIME' THEN 'LIBRARY_OR_RUNTIME' WHEN r.node IS NOT NULL AND provenance = 'APPLICATION' THEN 'NEEDS_RECOVERY' ELSE 'DEFERRED' END AS bucket
      FROM (SELECT DISTINCT dst AS subject FROM calls WHERE dst NOT IN (SELECT subject FROM obs WHERE predicate = 'decompiles_to' AND value IS NOT NULL AND subject IS NOT NULL)) LEFT JOIN reached r ON r.node = subject LEFT JOIN prov USING (subject)""",
    "u1_startup_only": _with(OBS, CALLS, ROOTS, SOLE, *STARTUP, recursive=True) + "SELECT node AS subject FROM startup",
    "g17_dispositions": _with(*_ALL, _DISPOSED, recursive=True) + "SELECT subject, n_callers, disposition FROM disposed",
    "a11_dispositions": _with(*_ALL, _DISPOSED, recursive=True) + "SELECT disposition, count(*) AS n, sum(n_callers)::BIGINT AS n_callers FROM disposed GROUP BY 1",
    "m15_gate": _with(OBS, CALLS, NAMES, CLASSES, *PROVENANCE, HYP, f"w AS (SELECT id, subject, predicate, {WORDS('value')} AS ws FROM hyp)",
        "again AS (SELECT DISTINCT a.id FROM w a JOIN w b ON a.subject = b.subject AND a.predicate = 'semantic_role' AND b.predicate = 'mechanical_behavior' WHERE len(a.ws) > 0 AND len(list_filter(a.ws, lambda x: NOT list_contains(b.ws, x))) = 0)",
        "plain AS (SELECT *, CASE WHEN last_verified_at IS NOT NULL AND confidence >= 0.85 THEN 'ACCEPTED' WHEN confidence >= 0.6 THEN 'SUPPORTED' ELSE 'PROPOSED' END AS st FROM hyp WHERE status NOT IN ('CONTESTED', 'REJECTED'))", recursive=True)
    + """SELECT id AS hypothesis_id, status AS old_status, CASE WHEN st = 'ACCEPTED' AND predicate = 'semantic_role' AND coalesce(provenance, 'UNKNOWN') <> 'APPLICATION' THEN 'REJECTED'
      WHEN st = 'ACCEPTED' AND id IN (SELECT id FROM again) THEN 'CONTESTED' ELSE st END AS new_status FROM plain LEFT JOIN prov USING (subject)""",
    "t23_parameters": f"SELECT * FROM (SELECT fact_id, {first_parameter('decompilation')} AS parameter, ({slots('decompilation', first_parameter('decompilation'))})::INT AS n_slots FROM function_facts) WHERE parameter <> ''",
}
