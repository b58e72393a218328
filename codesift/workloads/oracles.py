"""DuckDB SQL of the registered queries (rule families: see oracle_scan)."""

from __future__ import annotations

from codesift.functions.reports import CATEGORIES, NAME_SUFFIXES
from codesift.operators.clusters import KEYWORDS
from codesift.workloads.corpus import HEADS, NAMES, TOPICS
from codesift.workloads.oracle_scan import FILES, LANGUAGE, MINOR, lit, lst

REPORTS = f"""
rep as (select doc_id, source as firm, replace({lst(NAMES)}[doc_id % {len(NAMES)} + 1], '{{D}}', cast(doc_id as varchar)) as filename,
  list_transform(string_split(text, '. '), lambda p, i:
    replace({lst(HEADS)}[((i - 1) * 7 + doc_id * 13 + length(p)) % {len(HEADS)} + 1], '{{N}}', lpad(cast((i - 1) % 30 + 1 as varchar), 2, '0'))
    || p || '.' || {lst(TOPICS)}[((i - 1) * 5 + doc_id * 3 + length(p) * 11) % {len(TOPICS)} + 1]) as parts from documents),
reports as (select doc_id, firm, filename, firm || '/' || filename as rel_path, array_to_string(parts, chr(10)) as content from rep)"""

WS = "chr(32) || chr(9) || chr(10) || chr(13)"
HEADER = (r"'(?i)^#{1,4}\s+(?:\*{1,2})?\[?([A-Z]{1,4}[-–]?\d{1,3}|HIGH|MEDIUM|LOW|CRITICAL|INFORMATIONAL|INFO|GAS|QA|NOTE)"
          r"\]?(?:\*{1,2})?[:\s\-–]+(.+)?$'")


def severity(code: str) -> str:
    letters = rf"upper(regexp_replace({code}, '[-\s\d]', '', 'g'))"
    table = ("case {x} when 'C' then 'Critical' when 'CR' then 'Critical' when 'CRIT' then 'Critical' when 'H' then 'High' "
             "when 'HI' then 'High' when 'HIGH' then 'High' when 'M' then 'Medium' when 'MED' then 'Medium' when 'MEDIUM' then 'Medium' "
             "when 'L' then 'Low' when 'LO' then 'Low' when 'LOW' then 'Low' when 'I' then 'Info' when 'IN' then 'Info' "
             "when 'INFO' then 'Info' when 'N' then 'Info' when 'G' then 'Info' when 'Q' then 'Info' end")
    return f"coalesce({table.format(x=letters)}, {table.format(x=f'left({letters}, 1)')}, 'Info')"


def protocol(name: str) -> str:
    ext = rf"regexp_replace(regexp_replace({name}, '^\d{{4}}-\d{{2}}-\d{{2}}-?', ''), '(?i)\.md$', '')"
    out = ext
    for s in NAME_SUFFIXES:
        out = f"regexp_replace({out}, {lit(s)}, '')"
    return f"coalesce(nullif({out}, ''), nullif({ext}, ''), {name})"


def category(text: str, sev: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({text}), {lit(p)}) then {lit(n)}" for p, n in CATEGORIES) + f" else lower({sev}) end"


FINDINGS = f"""{REPORTS},
rl as (select doc_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as i from reports),
hd as (select *, trim(line, {WS}) as t from rl where starts_with(trim(line, {WS}), '#') and regexp_matches(trim(line, {WS}), {HEADER})),
hh as (select doc_id, i, regexp_extract(t, {HEADER}, 1) as code, trim(regexp_extract(t, {HEADER}, 2), {WS}) as head from hd
       where left(upper(regexp_extract(t, {HEADER}, 1)), 1) not in ('G', 'Q')),
hn as (select *, row_number() over (partition by doc_id order by i) - 1 as section_no, lead(i) over (partition by doc_id order by i) as nxt from hh),
sec as (select h.doc_id, h.section_no, h.code, h.head, list(l.line order by l.i) as body
        from hn h join rl l on l.doc_id = h.doc_id and l.i > h.i and (h.nxt is null or l.i < h.nxt) group by all),
s2 as (select *, trim(array_to_string(body, chr(10)), {WS}) as description, {severity('code')} as severity from sec),
s3 as (select s2.*, firm, filename, rel_path, {protocol('filename')} as protocol,
              list_filter(list_transform(body, lambda x: trim(x, {WS})), lambda x: length(x) > 5 and not starts_with(x, '#')
                          and not starts_with(x, '|') and not starts_with(x, '---'))[1] as tell
       from s2 join reports using (doc_id) where description <> ''),
s4 as (select *, trim(regexp_replace(tell, '\\*{{1,2}}([^*]+)\\*{{1,2}}', '\\1', 'g'), {WS}) as plain from s3),
findings as (select rel_path, cast(section_no as int) as section_no, firm || '__' || filename || '__' || code as finding_id,
  case when length(head) >= 5 then head when tell is not null then
    coalesce(nullif(case when length(plain) > 100 then left(plain, 97) || '...' else plain end, ''), severity || ' finding in ' || protocol)
  else coalesce(nullif(head, ''), severity || ' finding in ' || protocol) end as title,
  description, severity, protocol, {category('description', 'severity')} as category, 'solodit:' || rel_path || '#' || code as url from s4)"""

DOCS = f"""{FINDINGS},
docs as (select rel_path, section_no, 'Title: ' || title || chr(10) || 'Severity: ' || severity || chr(10) || 'Category: ' || category
  || chr(10) || 'Protocol: ' || protocol || chr(10) || chr(10) || trim(description, {WS}) as page_content,
  url as source, finding_id, severity, protocol, category, -1 as cluster_id from findings)"""

CHUNKS = f"""{DOCS},
chunks as (select rel_path, section_no, source, finding_id, severity, protocol, category, cluster_id, k as chunk_index,
  substr(page_content, k * 600 + 1, 800) as page_content
  from (select *, unnest(range(greatest(cast(ceil((length(page_content) - 200) / 600) as bigint), 1))) as k from docs))"""

STORE = """
store as (select vec_id, embedding::double[] as embedding, label as cluster_id, lang as category,
  ['Critical', 'High', 'Medium', 'Low', 'Info'][vec_id % 5 + 1] as severity, source as protocol, text as page_content
  from embeddings join documents on vec_id = doc_id)"""


def mean_vector(table: str, key: str, vec: str) -> str:
    return (f"(select {key}, list(m order by p) as vector from (select {key}, p, avg(v) as m from (select {key}, "
            f"unnest({vec}::double[]) as v, generate_subscripts({vec}, 1) as p from {table}) group by all) group by all)")


QUERIES = f"""{STORE},
q as (select cast(regexp_extract(protocol, '(\\d+)$', 1) as bigint) as query_id, embedding from store),
queries as (select query_id, vector as embedding from {mean_vector('q', 'query_id', 'embedding')}),
centroids as (select cluster_id, 'label-' || cluster_id as label, vector from {mean_vector('(select label as cluster_id, embedding from embeddings)', 'cluster_id', 'embedding')})"""

COS = "round(case when len({a}) <> len({b}) or list_inner_product({a}, {a}) = 0 or list_inner_product({b}, {b}) = 0 then 0 else list_cosine_similarity({a}, {b}) end, 6) + 0"

TOP_CLUSTERS = f"""{QUERIES},
chosen as (select query_id, cluster_id, similarity from (select query_id, cluster_id, {COS.format(a='q.embedding', b='c.vector')} as similarity
  from queries q, centroids c) qualify row_number() over (partition by query_id order by similarity desc, cluster_id) <= {{n}})"""

PER_CLUSTER = f"""{TOP_CLUSTERS},
hits as (select query_id, cluster_id, vec_id, similarity from (select query_id, h.cluster_id, vec_id,
    {COS.format(a='q.embedding', b='s.embedding')} as similarity
  from chosen h join queries q using (query_id) join store s on s.cluster_id = h.cluster_id)
  qualify row_number() over (partition by query_id, cluster_id order by similarity desc, vec_id) <= 3)"""

DIVERSE = f"""{PER_CLUSTER},
diverse as (select query_id, cast(row_number() over (partition by query_id order by similarity desc, vec_id) as int) as rank, label, vec_id, similarity
  from hits join centroids using (cluster_id)),
found as (select query_id, rank, label, severity, protocol, page_content from diverse join store using (vec_id))"""


def vector_sql() -> dict[str, str]:
    dv = DIVERSE.replace("{n}", "10")
    keywords = lst(KEYWORDS)
    return {
        "cosine_similarity": f"with {QUERIES} select vec_id, {COS.format(a='s.embedding', b='c.vector')} as similarity "
                             "from store s join centroids c using (cluster_id)",
        "join_vector_centroid": f"with {QUERIES}, t as (select vec_id, c.cluster_id, {COS.format(a='e.v', b='c.vector')} as similarity "
                                "from (select vec_id, embedding::double[] as v from embeddings) e, centroids c) "
                                "select * from t qualify row_number() over (partition by vec_id order by similarity desc, cluster_id) <= 3",
        "topk_clusters": f"with {TOP_CLUSTERS.replace('{n}', '10')} select * from chosen",
        "topk_per_cluster": f"with {PER_CLUSTER.replace('{n}', '10')} select * from hits",
        "topk_plain": f"with {QUERIES}, t as (select query_id, vec_id, {COS.format(a='q.embedding', b='s.embedding')} as similarity from queries q, store s) "
                      "select query_id, vec_id, similarity from t qualify row_number() over (partition by query_id order by similarity desc, vec_id) <= 10",
        "retrieve_cluster_diverse": f"with {dv} select * from diverse",
        "limit_raw_findings": f"with {dv} select query_id, rank, label, severity, protocol from found where rank <= 15",
        "retrieve_format": f"""with {dv} select query_id, cast(count(*) as varchar) || ' relevant vulnerability patterns from Solodit audit database:'
            || chr(10) || chr(10) || string_agg('[Finding ' || rank || '] Category: ' || label || ' | Severity: ' || severity || ' | Protocol: '
            || protocol || chr(10) || left(page_content, 400) || chr(10), chr(10) order by rank) filter (where rank <= 15) as context
            from found group by query_id""",
        "retrieve_compact": f"""with {dv} select query_id, string_agg('[' || rank || '] ' || label || ' | ' || severity || ' | ' || protocol || chr(10)
            || regexp_replace(left(page_content, 300), '\\n+', ' ', 'g'), chr(10) || chr(10) order by rank) as digest
            from found where rank <= 30 group by query_id""",
        "kmeans_assign": f"with {QUERIES} select vec_id, cluster_id from (select vec_id, c.cluster_id, list_distance(v, vector) as d from "
                         "(select vec_id, embedding::double[] as v from embeddings) e, centroids c) "
                         "qualify row_number() over (partition by vec_id order by d, cluster_id) = 1",
        "agg_centroid": f"with {QUERIES} select cluster_id, cast(p - 1 as int) as pos, round(v, 6) + 0 as value, (select count(*) from embeddings e where e.label = c.cluster_id) as size "
                        "from (select cluster_id, unnest(vector) as v, generate_subscripts(vector, 1) as p from centroids) c",
        "kmeans_step": f"""with {QUERIES}, near as (select vec_id, cluster_id, v from (select vec_id, c.cluster_id, v, list_distance(v, vector) as d from
            (select vec_id, embedding::double[] as v from embeddings) e, centroids c)
            qualify row_number() over (partition by vec_id order by d, cluster_id) = 1),
            m as (select cluster_id, p, avg(x) as value, count(*) as size from (select cluster_id, unnest(v) as x, generate_subscripts(v, 1) as p from near) group by all)
            select cluster_id, cast(p - 1 as int) as pos, round(value, 6) + 0 as value, size from m""",
        "join_cluster_assign": f"with {QUERIES}, near as (select vec_id, cluster_id from (select vec_id, c.cluster_id, list_distance(v, vector) as d from "
                               "(select vec_id, embedding::double[] as v from embeddings) e, centroids c) "
                               "qualify row_number() over (partition by vec_id order by d, cluster_id) = 1) "
                               "select vec_id, n.cluster_id, category, md5(page_content) as text_md5 from store join near n using (vec_id)",
        "agg_cluster_size": "select label as cluster_id, count(*) as size from embeddings group by label",
        "cluster_sample": f"with {STORE} select cluster_id, cast(rn as int) as rn, vec_id from (select *, row_number() over (partition by cluster_id order by vec_id) as rn from store) where rn <= 7",
        "cluster_label": f"""with {STORE}, cnt as (select cluster_id, category, count(*) as n from store group by all),
            base as (select cluster_id, category as base from cnt qualify row_number() over (partition by cluster_id order by n desc, category desc) = 1),
            smp as (select cluster_id, string_agg(lower(page_content), ' ' order by vec_id) as sample from
              (select *, row_number() over (partition by cluster_id order by vec_id) as rn from store) where rn <= 5 group by all),
            nm as (select b.*, row_number() over (partition by base order by cluster_id) as turn,
              regexp_replace(base, '_\\d+$', '') || '_' || coalesce(list_filter({keywords}, lambda k: contains(sample, replace(k, '_', ''))
                and not contains(regexp_replace(base, '_\\d+$', ''), replace(k, '_', '')))[1], cast(cluster_id as varchar)) as second
              from base b join smp using (cluster_id))
            select cluster_id, replace(case when turn = 1 then base when row_number() over (partition by base, second, turn > 1 order by cluster_id) = 1 then second
              else second || '_' || cluster_id end, '-', '_') as label from nm""",
    }


def report_sql() -> dict[str, str]:
    return {
        "section_split": f"with {FINDINGS} select * from findings",
        "extract_severity": f"with {FINDINGS} select rel_path, section_no, severity from findings",
        "extract_protocol": f"with {REPORTS} select rel_path, {protocol('filename')} as protocol from reports",
        "infer_category": f"with {FINDINGS} select rel_path, section_no, category from findings",
        "infer_title": f"with {FINDINGS} select rel_path, section_no, title from findings",
        "finding_to_document": f"with {DOCS} select * from docs",
        "chunk_split": f"with {CHUNKS} select rel_path, section_no, finding_id, cast(chunk_index as int) as chunk_index, page_content from chunks",
    }


# --- files -------------------------------------------------------------------

def _rxm(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


# Doubles, added in the order of the score's terms: decimals would order near ties differently.
SCORE = ("(case when " + _rxm("low", "transfer|withdraw|deposit|balance|stake|unstake|claim|fee|reward|pay|send|mint|burn") + " then 0.30::double else 0::double end"
         " + case when " + _rxm("low", r"\.call\b|delegatecall|\.invoke|cpi::|cross.chain|callback|hook") + " then 0.25::double else 0::double end"
         " + case when " + _rxm("low", r"onlyowner|onlyadmin|require.*msg\.sender|authority|role|permission|admin") + " then 0.15::double else 0::double end"
         " + case when " + _rxm("low", r"mapping|storage\b|mut\s+\w|global\s+\w") + " then 0.10::double else 0::double end"
         " + case when " + _rxm("low", "muldiv|wadmul|raymul|shares?|rate|index|price|oracle|twap") + " then 0.15::double else 0::double end"
         " - case when " + _rxm("content", r"(?m)^interface\s+|//.*SPDX.*interface|pub\s+trait\s+") + " then 0.20::double else 0::double end)")

IMPORT_PATTERNS = [r"""import\s+(?:\{[^}]+\}\s+from\s+)?["']([^"']+)["']""", r"(?m)^mod\s+(\w+)\s*;", r"use\s+[\w:]+::(\w+)",
                   r'import\s+(?:\w+\s+)?"([^"]+)"']
_ALL_IMPORTS = "list_concat(" + ", ".join(f"regexp_extract_all(content, {lit(p)}, 1)" for p in IMPORT_PATTERNS) + ")"

FEATS = f"""{FILES},
f0 as (select *, lower(content) as low from files),
f1 as (select *, {SCORE} as s0, {LANGUAGE} as language, length(content) as size,
  list_filter({_ALL_IMPORTS}, lambda x, i: list_position({_ALL_IMPORTS}, x) = i) as imports from f0),
feats as (select doc_id, project_id, path, content, lines, language, size, imports,
  greatest(0::double, least(1::double, s0 - case when s0 < 0.2::double and regexp_matches(content, '(?m)^library\\s+\\w+\\s*\\{{') then 0.1::double else 0::double end)) as attack_score from f1),
seen as (select f.project_id, f.path from files f where doc_id in (select doc_id from labels))"""

FIRST = "(select project_id, path as first from feats qualify row_number() over (partition by project_id order by attack_score desc, path) = 1)"


def _skip(tree: bool = True) -> str:
    from codesift.operators.features import SKIP_DIRS, SKIP_DIRS_ANY_CASE, SKIP_NAMES, SKIP_SUFFIXES_ANY_CASE

    def hit(x: str) -> str:
        return "(" + " or ".join([
            _rxm(x, rf"(^|/)({SKIP_DIRS})/"), _rxm(x, rf"(?i)(^|/)({SKIP_DIRS_ANY_CASE})/"), _rxm(x, "__pycache__/"),
            _rxm(x, rf"({SKIP_NAMES})$"), _rxm(x, rf"(?i)({SKIP_SUFFIXES_ANY_CASE})$")]) + ")"

    if not tree:  # entries of an archive: the whole path only
        return hit("path")
    # Walk the tree: at each level both the relative path and the bare name are tested.
    return (f"with {FILES}, w as (select project_id, path, string_split(path, '/') as p from files) select project_id, path from w "
            f"where len(list_filter(range(1, len(p) + 1), lambda i: {hit(chr(97) + 'rray_to_string(p[1:i], chr(47))')} or {hit('p[i]')})) = 0")


FALLBACK = "language || ' file with ' || len(imports) || ' import(s). Score: ' || printf('%.2f', attack_score) || '.'"
TRIVIAL = "'Small ' || language || ' file — likely interface, constants, or stub.'"
SUMMARIES = f"""summaries as (select *, attack_score > 0.8 as given,
  case when size < 200 then {TRIVIAL} when attack_score > 0.8 then 'Moves value in ' || path else {FALLBACK} end as summary,
  case when size >= 200 and attack_score > 0.8 then 'run()' else '' end as entry_points,
  case when size >= 200 and attack_score > 0.8 then 'Oracle.sol, Pool.sol' else array_to_string(imports, ', ') end as deps from feats)"""
LN = "ln as (select project_id, path, unnest(lines) as line, generate_subscripts(lines, 1) as line_no from files)"
NAME = ("case when len(string_split(first, '/')) = 1 then 'Protocol' when string_split(first, '/')[1] = '.' "
        "then string_split(first, '/')[2] else string_split(first, '/')[1] end")


def features_sql() -> dict[str, str]:
    from codesift.workloads.oracle_scan import COMMENT

    f = f"with {FEATS}"
    return {
        "path_skip_filter": _skip(),
        "binary_filter": """with t as (select source as project_id, cast(doc_id as varchar) as path,
            case when doc_id % 3 = 0 then replace(text, 'e', chr(1)) else text end as content from documents)
            select project_id, path from t where not coalesce(len(regexp_extract_all(content, '[\\x00-\\x08\\x0e-\\x1f\\x7f]')) / nullif(length(content), 0) > 0.05, false)""",
        "comment_filter": f"with {FILES}, {LN} select project_id, path, count(*) as n_lines, cast(sum(line_no) as bigint) as sum_line_no from ln where not {COMMENT} group by all",
        "confidence_filter": f"with {NOTES} select project_id, target_file, confidence from notes where confidence >= 0.7",
        "score_filter": f"{f} select project_id, path from feats where attack_score > 0.1 and (project_id, path) not in (select (project_id, path) from seen)",
        "join_unseen": f"{f} select project_id, path from feats where (project_id, path) not in (select (project_id, path) from seen)",
        "resume_filter": f"with {REPORTS} select rel_path from reports where doc_id not in (select doc_id from labels)",
        "detect_language": f"with {FILES} select project_id, path, {LANGUAGE} as language from files",
        "attack_score": f"{f} select project_id, path, round(attack_score, 2) as attack_score from feats",
        "extract_imports": f"{f} select project_id, path, array_to_string(imports, '|') as imports from feats",
        "build_source_file": f"{f} select project_id, path, language, size, round(attack_score, 2) as attack_score, cast(len(imports) as int) as n_imports, md5(content) as content_md5 from feats",
        "file_context": f"""with {FILES} select project_id, path, contains(lower(content), 'safetransfer(') or contains(lower(content), 'safetransferfrom(') as has_safe_erc20,
            contains(lower(content), 'nonreentrant') or contains(lower(content), 'reentrancyguard') as has_reentrancy_guard,
            contains(lower(content), 'chainid') as has_chain_id, contains(lower(content), 'using safemath for') as has_safe_math, {MINOR} as pragma_minor from files""",
        "trivial_summary": f"{f} select project_id, path, case when size < 200 then {TRIVIAL} else {FALLBACK} end as summary, array_to_string(imports, ', ') as deps from feats",
        "fallback_summary": f"{f}, {SUMMARIES} select project_id, path, summary, entry_points, deps from summaries",
        "project_name": f"{f} select project_id, {NAME} as name from {FIRST}",
        "function_signatures": f"{f} select f.project_id, f.path, array_to_string(regexp_extract_all(content, 'function \\w+\\([^)]*\\)[^{{]*')[1:10], chr(10)) as signatures "
                               "from feats f join (select project_id, path from feats qualify row_number() over (partition by project_id order by attack_score desc, path desc) = 1) b "
                               "on f.project_id = b.project_id and f.path = b.path",
        "count_in_line": f"with {FILES} select project_id, path, len(regexp_extract_all(content, ',')) as commas, len(regexp_extract_all(content, '\\{{')) as opened, "
                         "len(regexp_extract_all(content, '\\}')) as closed from files",
        "explode_lines": f"with {FILES}, {LN} select project_id, path, cast(line_no as int) as line_no, line from ln",
        "explode_imports": f"{f} select project_id, path, unnest(imports) as import from feats",
        "sort_attack_score": f"{f} select project_id, path, round(attack_score, 2) as attack_score from feats order by attack_score desc, project_id, path",
    }


# --- rule scan ---------------------------------------------------------------

LEAD_COLS = "project_id, pattern_id, severity, confidence, file, line_no, snippet"


def _all_leads() -> str:
    from codesift.workloads import oracle_scan as o

    part = o.leads_cte(list(o.RULES))
    moved = o.DISPLACED.split(",\nln as", 1)[1].replace("leads as", "leads_b as").replace("ln.", "ln_b.").replace(" ln ", " ln_b ").replace("from ln\n", "from ln_b\n")
    loops = o.LOOPS.split(",\nln as", 1)[1].replace("leads as", "leads_c as").replace("from ln)", "from ln_c)")
    cols = LEAD_COLS
    return (f"{part},\nln_b as{moved},\nln_c as{loops.replace('anchors', 'anchors_c')},\n"
            f"every as (select {cols} from leads union all select {cols} from leads_b union all select {cols} from leads_c)")


def scan_sql() -> dict[str, str]:
    from codesift.workloads import oracle_scan as o
    from codesift.workloads.catalog import FAMILIES, rule_ids

    out = {name: o.leads_cte(rule_ids(name)) + " select * exclude (verify) from leads" for name in FAMILIES}
    every = _all_leads()
    rank = "case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end"
    texts = "(" + ", ".join(f"({lit(k[:7])}, {lit(m[0])}, cast({m[1]} as double), {lit(m[3])}, {lit(m[4])}, {lit(m[2])})" for k, m in o.MESSAGES.items()) + ")"
    del texts
    out |= {
        "scan_displaced": f"{o.DISPLACED} select {LEAD_COLS} from leads",
        "scan_brace_depth": f"{o.LOOPS} select {LEAD_COLS} from leads where severity = 'HIGH'",
        "scan_nesting_count": f"{o.LOOPS} select {LEAD_COLS} from leads where severity = 'MEDIUM'",
        "lead_rank": f"{every} select * from every",
        "lead_summary": f"""{every}, cats as (select distinct substr(branch, 1, 7) as pattern_id, category from messages)
            select project_id, severity, category, count(*) as n_leads from every join cats using (pattern_id) group by all""",
        "lead_block": f"""{every},
            full_leads as (select e.*, coalesce(l.signal, m.signal) as signal, m.verify from every e
              join (select substr(branch, 1, 7) as pattern_id, severity, confidence, signal, verify from messages
                    qualify row_number() over (partition by substr(branch, 1, 7), severity, confidence order by branch) = 1) m using (pattern_id, severity, confidence)
              left join leads l on l.project_id = e.project_id and l.file = e.file and l.line_no = e.line_no and l.pattern_id = e.pattern_id),
            top as (select *, row_number() over (partition by project_id order by confidence desc, {rank}, file, line_no, pattern_id) as rn,
                    count(*) over (partition by project_id) as found from full_leads)
            select project_id, '=== PRE-SCAN LEADS — verify these first (' || count(*) || ' of ' || any_value(found) || ' found) ===' || chr(10) || chr(10)
              || string_agg('[LEAD-' || rn || '] ' || pattern_id || ' | ' || severity || ' | confidence:' || cast(round(confidence * 100) as int) || '% | ' || file || ':' || line_no
                || chr(10) || '  Code:   ' || left(snippet, 120) || chr(10) || '  Signal: ' || signal || chr(10) || '  Verify: ' || verify || chr(10), chr(10) order by rn)
              || chr(10) || 'After verifying each lead, apply methodology to find what the scanner missed.' || chr(10)
              || 'A genuine zero-finding result is extremely rare. If leads look like false positives,' || chr(10)
              || 'explain why specifically before concluding — do not silently dismiss.' || chr(10) || '===' as block
            from top where rn <= 8 group by project_id""",
    }
    return out


# --- joins -------------------------------------------------------------------

NOTES = f"""{FILES},
notes as (select project_id,
  case doc_id % 4 when 0 then path when 1 then string_split(path, '/')[-1] when 2 then 'C' || doc_id || '.' else 'repo/' || path end as target_file,
  case when doc_id % 3 = 0 then 'withdraw()' end as target_function, 'review the flow of C' || doc_id as reason,
  (doc_id * 37 % 100 / 100.0)::double as confidence, 'auditor-' || (doc_id % 3 + 1) as auditor_id, cast(doc_id % 2 + 1 as int) as pass_no from files)"""

MATCH = ("(n.target_file = f.path or string_split(n.target_file, '/')[-1] = string_split(f.path, '/')[-1] "
         "or contains(f.path, n.target_file) or contains(n.target_file, f.path))")
NOTES_FEATS = NOTES + FEATS[len(FILES):]
STRONG = f"""{NOTES_FEATS},
targets as (select * from feats f where exists (select 1 from notes n where n.project_id = f.project_id and n.confidence >= 0.7 and {MATCH})),
neighbours as (select * from feats f where not exists (select 1 from targets t where t.project_id = f.project_id and t.path = f.path)
  and exists (select 1 from targets t where t.project_id = f.project_id and (
    len(list_filter(t.imports, lambda x: contains(f.path, x) or contains(x, string_split(f.path, '/')[-1]))) > 0
    or len(list_filter(f.imports, lambda x: contains(t.path, x) or contains(x, string_split(t.path, '/')[-1]))) > 0)))"""
INJECTED = f"""injected as (select f.project_id, f.path, n.pass_no,
  case when target_function is not null then target_function || ': ' else '' end || reason || ' [confidence: ' || confidence || ']' as note
  from notes n join files f on n.project_id = f.project_id and {MATCH} where n.confidence >= 0.7)"""


def joins_sql() -> dict[str, str]:
    return {
        "join_fuzzy_path": f"with {NOTES} select distinct n.project_id, n.target_file, f.path from notes n join files f on n.project_id = f.project_id and {MATCH}",
        "join_suspicion_targets": f"with {STRONG} select project_id, path from targets",
        "join_import_neighbours": f"with {STRONG} select project_id, path from neighbours",
        "join_inject_suspicions": f"with {NOTES}, {INJECTED} select * from injected",
    }


# --- findings ----------------------------------------------------------------

def _found_sql() -> str:
    from codesift.workloads import corpus as c

    title = (f"{lst(c.WORD_A)}[(l_partkey * 7 + l_linenumber) % 12 + 1] || ' ' || {lst(c.WORD_B)}[(l_partkey * 3 + l_suppkey) % 16 + 1] || ' in fn' "
             "|| ((l_orderkey * 11 + l_partkey * 5 + l_linenumber * 17) % 50) || '()'")
    return f"""
fnd as (select l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber as finding_id, 'P' || (l_orderkey // 500) as project_id,
  'src/F' || (l_partkey % 40) || '.sol' as file, cast((l_partkey * 7 + l_linenumber * 13 + l_suppkey) % 400 as int) as line,
  {lst(c.AUDITORS)}[l_suppkey % 3 + 1] as auditor_id, cast(l_linenumber % 3 as int) as pass_no, {lst(c.PASS_KINDS)}[l_linenumber % 3 + 1] as pass_kind,
  {lst(c.SEVERITIES)}[(l_partkey * 3 + l_linenumber * 7 + l_suppkey) % 5 + 1] as severity,
  {lst(c.CATEGORIES)}[(l_partkey + l_orderkey * 5 + l_linenumber) % 6 + 1] as category, {title} as title from lineitem)"""


FND = _found_sql()
TOK = f"""{FND},
tok as materialized (select *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda t: t <> ''))) as tokens from fnd)"""
JAC = "len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.5"
KEYED = f"""recursive {TOK},
pairs as materialized (select a.finding_id as a, b.finding_id as b from tok a join tok b on a.project_id = b.project_id and a.file = b.file and a.finding_id <> b.finding_id
  where ({JAC}) or (a.category = b.category and abs(a.line - b.line) <= 5)),
reach(id, root) as (select finding_id, finding_id from fnd union select p.b, r.root from reach r join pairs p on p.a = r.id),
keyed as materialized (select f.*, k.merge_key from fnd f join (select id, min(root) as merge_key from reach group by id) k on k.id = f.finding_id)"""
SEV = "case severity when 'Critical' then 0 when 'High' then 1 when 'Medium' then 2 when 'Low' then 3 else 4 end"
MERGED = f"""{KEYED},
lead as (select * from keyed qualify row_number() over (partition by merge_key order by {SEV}, finding_id) = 1),
merged as materialized (select l.project_id, l.file, l.merge_key, l.severity, l.title, l.line, l.category, a.auditors, a.n_findings,
   least(1.0, round(0.6 + 0.2 * (a.n_auditors - 1), 6))::double as confidence
 from lead l join (select merge_key, string_agg(distinct auditor_id, ',' order by auditor_id) as auditors, count(*) as n_findings,
   count(distinct auditor_id) as n_auditors from keyed group by merge_key) a using (merge_key))"""


def findings_sql() -> dict[str, str]:
    head = " || chr(10) || ".join(f"'| {s} | ' || count(*) filter (where severity = '{s}') || ' |'" for s in ("Critical", "High", "Medium", "Low", "Info"))
    valid = responses_sql()["parse_findings"]
    return {
        "finding_validity": f"select resp_id, ord, severity, title, line from ({valid})",
        "union_findings": f"with {FND} select finding_id, project_id, file, auditor_id, pass_no from fnd",
        "join_near_duplicate": f"with {KEYED} select finding_id, project_id, file, merge_key from keyed",
        "agg_finding_merge": f"with {MERGED} select * from merged",
        "agg_weighted_confidence": f"""with {KEYED}, v as (select project_id, file, merge_key, auditor_id,
            max(case pass_kind when 'targeted' then 1.3 when 'verification' then 1.6 else 1.0 end) as w from keyed group by all)
            select project_id, file, merge_key, round(sum(w) / 3, 6)::double as weighted_confidence from v group by all""",
        "agg_severity_counts": f"""with {FND} select p.project_id, s.severity, count(f.finding_id) as n from (select distinct project_id from fnd) p
            cross join (select unnest(['Critical','High','Medium','Low','Info']) as severity) s left join fnd f using (project_id, severity) group by all""",
        "sort_report": f"with {MERGED} select project_id, severity, confidence, file, merge_key from merged order by project_id, {SEV}, confidence desc, file, merge_key",
        "fallback_findings": f"with {FND} select project_id, finding_id, 0.6::double as confidence, auditor_id as auditors from fnd "
                             "where project_id not in (select project_id from fnd where file = 'src/F7.sol' and severity = 'Critical' and category = 'dos')",
        "eval_coverage": f"""with {TOK}, truth as (select * from tok where auditor_id = 'auditor-1'),
            s as (select a.finding_id as truth_id, b.auditor_id, max(case when {JAC} then 2 when abs(a.line - b.line) <= 5 then 1 else 0 end) as hit
              from truth a join tok b on a.project_id = b.project_id and a.file = b.file group by all)
            select finding_id as truth_id, case s2.hit when 2 then 'found' when 1 then 'partial' else 'missed' end as auditor_2,
              case s3.hit when 2 then 'found' when 1 then 'partial' else 'missed' end as auditor_3
            from truth t left join s s2 on s2.truth_id = t.finding_id and s2.auditor_id = 'auditor-2'
            left join s s3 on s3.truth_id = t.finding_id and s3.auditor_id = 'auditor-3'""",
        "render_report": f"""with {MERGED},
            heads as (select project_id, 0 as part, '' as merge_key,
              '# Security Audit Report' || chr(10) || chr(10) || '**Generated:** 2024-01-01T00:00:00Z' || chr(10) || '**Duration:** 1.0s' || chr(10)
              || '**Files audited:** ' || any_value(n_files) || chr(10) || '**Auditors:** model-a, model-b' || chr(10) || '**Supervisor:** rules' || chr(10) || chr(10)
              || '## Summary' || chr(10) || chr(10) || '| Severity | Count |' || chr(10) || '|----------|-------|' || chr(10) || {head}
              || chr(10) || chr(10) || '**Total findings:** ' || count(*) || chr(10) || chr(10) || '## Findings' || chr(10) as text
              from merged join (select project_id, count(distinct file) as n_files from fnd group by all) using (project_id) group by project_id),
            blocks as (select project_id, 1 as part, merge_key, '### [' || severity || '] ' || title || chr(10) || chr(10) || '**File:** `' || file || '` (line ' || line || ')' || chr(10)
              || '**Confidence:** ' || cast(round(confidence * 100) as int) || '%' || chr(10) || '**Flagged by:** ' || replace(auditors, ',', ', ') || chr(10) || chr(10)
              || '**Description:** What goes wrong: ' || title || chr(10) || chr(10) || '**Exploit:** Call it twice in ' || file || chr(10) || chr(10)
              || '**Recommendation:** Add a guard in ' || file || chr(10) || chr(10) || '---' || chr(10) as text from merged)
            select * from heads union all select * from blocks
            union all select regexp_replace(project_id, '^src', 'P'), 2, merge_key, text from ({packing_sql()['render_report_map']})""",
    }


# --- responses ---------------------------------------------------------------

def _responses_cte() -> str:
    from codesift.workloads import corpus as c

    def item(sev: str, title: str, line: str) -> str:
        return (f"'{{\"severity\": \"' || {sev} || '\", \"title\": \"' || {title} || '\", \"file\": \"src/F' || (o_orderkey % 40) || '.sol\", \"line\": ' || {line} "
                "|| ', \"description\": \"The order ' || o_orderkey || ' is paid twice here\", \"exploit\": \"Pay order ' || o_orderkey "
                "|| ' twice\", \"recommendation\": \"Mark it as paid\"}'")

    first = item(f"{lst([*c.SEVERITIES, 'Severe'])}[o_orderkey % 6 + 1]", "'Order ' || o_orderkey", "(o_orderkey % 300)")
    second = item(f"{lst(c.SEVERITIES)}[o_orderkey % 5 + 1]", "case when o_orderkey % 7 = 0 then 'Tiny' else 'Second look' end",
                  "case o_orderkey % 11 when 0 then '-1' when 1 then '1.5' else cast(o_orderkey % 90 as varchar) end")
    return f"""
r0 as (select o_orderkey as resp_id, {lst(c.AUDITORS)}[o_custkey % 3 + 1] as auditor_id, cast(o_orderkey % 3 + 1 as int) as pass_no, (o_orderkey // 6) % 6 as kind,
  '[' || {first} || ', ' || {second} || ']' as arr,
  '[{{"targetFile": "src/F' || (o_orderkey % 40) || '.sol", "reason": "looks odd in order ' || o_orderkey || '", "confidence": '
   || case when o_orderkey % 13 = 0 then '1.5' else cast((o_orderkey % 100 / 100.0)::double as varchar) end || '}}]' as note from orders),
responses as (select resp_id, auditor_id, pass_no, case kind when 0 then '<think>balances[a] {{x}}</think>' || chr(10) || arr
  when 1 then 'Here:' || chr(10) || '```json' || chr(10) || '{{"findings": ' || arr || '}}' || chr(10) || '```' || chr(10) || 'Done.'
  when 2 then arr when 3 then 'The result follows: ' || arr when 4 then arr || chr(10) || 'SUSPICIONS:' || chr(10) || note
  else left(arr, length(arr) - 2) end as raw from r0),
stripped as (select *, trim(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), {WS}) as text from responses),
split as (select *, trim(case when contains(text, 'SUSPICIONS:') then left(text, instr(text, 'SUSPICIONS:') - 1) else text end, {WS}) as body,
  trim(case when contains(text, 'SUSPICIONS:') then substr(text, instr(text, 'SUSPICIONS:') + 11) else '' end, {WS}) as tail from stripped)"""


def _found_json(text: str) -> str:
    fence = f"trim(regexp_extract({text}, '(?s)```(?:json)?\\s*(.*?)```', 1), {WS})"
    scan = (f"list_filter(range(length({text}), 0, -1), lambda p: substr({text}, p, 1) = '{{m}}' and json_valid(substr({text}, p)))[1]")
    right = f"coalesce(substr({text}, {scan.replace('{m}', '[')}), substr({text}, {scan.replace('{m}', '{')}))"
    return f"case when {text} = '' then null when json_valid({text}) then {text} when json_valid({fence}) then {fence} else {right} end"


RESP = f"""{_responses_cte()},
js as (select *, {_found_json('body')} as body_json, {_found_json('tail')} as tail_json from split),
items as (select resp_id, auditor_id, pass_no, unnest(json_extract(arr, '$[*]')) as j, generate_subscripts(json_extract(arr, '$[*]'), 1) - 1 as ord
  from (select *, case when json_type(body_json) = 'ARRAY' then body_json::json else json_extract(body_json, '$.findings') end as arr from js where body_json is not null)),
typed as (select *, json_type(j, '$.line') in ('BIGINT', 'UBIGINT', 'DOUBLE') and try_cast(j ->> '$.line' as double) >= 0
    and try_cast(j ->> '$.line' as double) = floor(try_cast(j ->> '$.line' as double)) and json_type(j, '$.severity') = 'VARCHAR'
    and (j ->> '$.severity') in ('Critical', 'High', 'Medium', 'Low', 'Info') and length(j ->> '$.title') >= 5 and (j ->> '$.file') is not null
    and length(j ->> '$.description') >= 20 and length(j ->> '$.exploit') >= 10 and length(j ->> '$.recommendation') >= 10 as valid from items),
notes_all as (select resp_id, auditor_id, pass_no, unnest(json_extract(tail_json, '$[*]')) as j, generate_subscripts(json_extract(tail_json, '$[*]'), 1) - 1 as ord
  from js where tail_json is not null)"""


def responses_sql() -> dict[str, str]:
    r = f"with {RESP}"
    note_ok = "length(j ->> '$.reason') >= 10 and try_cast(j ->> '$.confidence' as double) between 0 and 1 and (j ->> '$.targetFile') is not null"
    note = ("cast(ord as int) as ord, j ->> '$.targetFile' as target_file, j ->> '$.targetFunction' as target_function, j ->> '$.reason' as reason, "
            "try_cast(j ->> '$.confidence' as double) as confidence")
    return {
        "strip_think": f"with {_responses_cte()} select resp_id, text from stripped",
        "split_suspicions": f"with {_responses_cte()} select resp_id, body, tail from split",
        "extract_json": f"{r} select resp_id, body_json as found from js",
        "explode_responses": f"{r} select resp_id, cast(ord as int) as ord, j ->> '$.title' as title from items",
        "parse_findings": f"""{r} select resp_id, auditor_id, pass_no, cast(ord as int) as ord, j ->> '$.severity' as severity, j ->> '$.title' as title, j ->> '$.file' as file,
            cast(cast(j ->> '$.line' as double) as int) as line, j ->> '$.description' as description, j ->> '$.exploit' as exploit, j ->> '$.recommendation' as recommendation
            from typed where valid""",
        "parse_suspicions": f"{r} select resp_id, auditor_id, pass_no, {note} from notes_all where {note_ok}",
        "parse_rejects": f"""{r} select resp_id, cast(null as int) as ord, 'no JSON' as reason from js where body_json is null and body <> ''
            union all select resp_id, cast(ord as int), 'finding not valid' from typed where not coalesce(valid, false)
            union all select resp_id, cast(ord as int), 'note not valid' from notes_all where not coalesce({note_ok}, false)""",
        "tag_suspicions": f"{r} select resp_id, {note}, 'auditor-1' as auditor_id, 2 as pass_no from notes_all where {note_ok}",
        "agg_status": f"""{r}, n as (select resp_id, count(*) as n from typed where valid group by all)
            select auditor_id, case when raw is null then 'failed' when n > 0 then 'ok' else 'empty' end as status, count(*) as n
            from responses left join n using (resp_id) group by all""",
    }


# --- packing and texts ---------------------------------------------------------

def packing_sql() -> dict[str, str]:
    f = f"with {FEATS}"
    rule = "repeat('═', 52)"
    score = "case when attack_score > 0 then printf(' score:%.2f', attack_score) else '' end"
    project_map = f"""with {NOTES_FEATS}, {SUMMARIES}, {INJECTED},
        about as (select s.project_id, '{{h}}PROTOCOL MAP — ' || name || ' (' || n || ' files · ' || language || ')' || chr(10) || {rule} || chr(10) as text from
          (select project_id, count(*) as n from feats group by all) s join (select project_id, {NAME} as name from {FIRST}) using (project_id)
          join (select project_id, language from (select project_id, language, count(*) as n from feats group by all)
            qualify row_number() over (partition by project_id order by n desc, language desc) = 1) using (project_id))
        select project_id, 0 as part, '' as path, 0 as sub, 0 as pass_no, replace(text, '{{h}}', '') as text from about
        union all select project_id, 2, '', 0, 0, {rule} from about
        union all select project_id, 1, path, 0, 0, '[' || path || ']' || {score} || chr(10) || '  What it does: ' || summary
          || case when entry_points <> '' then chr(10) || '  Entry points: ' || entry_points else '' end
          || case when deps <> '' then chr(10) || '  Calls into: ' || deps else '' end from summaries
        union all select project_id, 1, path, 2, 0, '' from summaries
        union all select project_id, 1, path, 1, pass_no, '  ⚠ Suspicion [Pass ' || pass_no || ']: ' || note from injected"""
    return {
        "agg_project_size": f"{f} select project_id, cast(sum(size) as bigint) as total_chars, case when sum(size) <= 84288 * 0.85 then 'small' "
                            "when sum(size) <= 84288 * 3 then 'medium' else 'large' end as project_size from feats group by project_id",
        "agg_dominant_language": f"{f} select project_id, language from (select project_id, language, count(*) as n from feats group by all) "
                                 "qualify row_number() over (partition by project_id order by n desc, language desc) = 1",
        "agg_coverage": f"{f} select project_id, bool_and(attack_score <= 0.3 or (project_id, path) in (select (project_id, path) from seen)) as covered from feats group by project_id",
        "render_map": project_map,
        "render_report_map": f"""with m as ({project_map})
            select project_id, part + 1 as rank, path as file, sub || '-' || lpad(cast(pass_no as varchar), 5, '0') as merge_key, text from m
            union all select project_id, 0, '', '', '## Protocol Map' || chr(10) || chr(10) || repeat('`', 3) from m where part = 0
            union all select project_id, 4, '', '', repeat('`', 3) from m where part = 0""",
    }


def ingest_sql() -> dict[str, str]:
    chunks = f"with {CHUNKS} select rel_path, section_no, finding_id, cast(chunk_index as int) as chunk_index, page_content from chunks"
    return {
        "ingest_stream": chunks,
        "ingest_idempotent": chunks,
        "agg_run_stats": f"with {CHUNKS}, n as (select rel_path, count(*) as c from chunks group by all) select count(*) filter (where c > 0) as processed, "
                         "count(*) filter (where c is null) as empty, 0::bigint as skipped, cast(coalesce(sum(c), 0) as bigint) as chunks from reports left join n using (rel_path)",
        "check_embeddings": """select count(distinct label % 3) as models, cast(min(len(embedding)) as int) as min_dim, cast(max(len(embedding)) as int) as max_dim,
            (select count(*) from documents where doc_id not in (select vec_id from embeddings)) as chunks_without_vector,
            count(*) filter (where vec_id not in (select doc_id from documents)) as vectors_without_chunk,
            (select count(*) from documents where doc_id not in (select vec_id from embeddings)) = 0
              and count(*) filter (where vec_id not in (select doc_id from documents)) = 0 and min(len(embedding)) = max(len(embedding)) and count(distinct label % 3) = 1 as ok from embeddings""",
        "scan_stream": f"{_all_leads()} select * from every",
    }


def _fit_sql() -> str:
    """Five rounds, one after another, from the vectors of the ten smallest ids."""
    near = ("a{r} as materialized (select vec_id, v, cluster_id from (select vec_id, v, c.cluster_id, list_distance(v, vector) as d from e, c{r} c) "
            "qualify row_number() over (partition by vec_id order by d, cluster_id) = 1)")
    move = ("c{n} as materialized (select c.cluster_id, coalesce(m.vector, c.vector) as vector from c{r} c left join (select cluster_id, list(x order by p) as vector from "
            "(select cluster_id, p, avg(x) as x from (select cluster_id, unnest(v) as x, generate_subscripts(v, 1) as p from a{r}) group by all) group by all) m using (cluster_id))")
    steps = ["e as materialized (select vec_id, embedding::double[] as v from embeddings)",
             "c0 as materialized (select row_number() over (order by vec_id) - 1 as cluster_id, v as vector from e order by vec_id limit 10)"]
    for r in range(5):
        steps += [near.format(r=r), move.format(r=r, n=r + 1)]
    return f"with {', '.join([*steps, near.format(r=5)])} select cast(cluster_id as int) as cluster_id, count(*) as size from a5 group by all"


def storage_sql() -> dict[str, str]:
    base = features_sql()["build_source_file"]
    kept = f"with b as ({base}), k as ({_skip()}) select b.* from b join k using (project_id, path)"
    zipped = f"with b as ({base}) select * from b where not {_skip(tree=False)}"
    audit = findings_sql()["render_report"]
    return {
        "src_tree_scan": kept,
        "src_zip_scan": zipped,
        "src_unified": f"select * replace ('all' as project_id) from ({zipped})",
        "src_report_scan": f"with {REPORTS} select firm, filename, rel_path, md5(content) as content_md5 from reports",
        "src_embeddings_jsonl": f"with {STORE} select vec_id, category, cast(generate_subscripts(embedding, 1) - 1 as int) as pos, unnest(embedding) as value from store",
        "sink_vector_table": f"with {STORE} select vec_id, cluster_id, category, cast(len(embedding) as int) as dim, md5(page_content) as text_md5 from store",
        "src_vector_table": f"with {STORE}, n as (select label, count(*) as n from embeddings group by all) select vec_id, cluster_id from store "
                            "where cluster_id in (select label from n where n > (select avg(n) from n))",
        "sink_centroids": f"select cluster_id, 'label-' || cluster_id as label, size, pos, value from ({vector_sql()['agg_centroid']})",
        "sink_leads": scan_sql()["lead_rank"],
        "sink_report": f"""with r as ({audit}), l as (select project_id, unnest(string_split(text, chr(10))) as line from r)
            select project_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars, cast(sum(cast('0x' || md5(line)[1:8] as bigint)) as bigint) as checksum
            from l group by project_id""",
    }


def all_sql() -> dict[str, str]:
    return storage_sql() | {"kmeans_fit": _fit_sql()} | (features_sql() | scan_sql() | report_sql() | joins_sql() | findings_sql() | responses_sql() | packing_sql()
            | vector_sql() | ingest_sql() | batches_sql())


# --- greedy packing: one batch is a fold over the remaining files --------------

_FILE = "struct(path varchar, size bigint, score double)"
_EMPTY = f"[]::{_FILE}[]"


def pack_cte(name: str, source: str, order: str, batches: int | None, budget: int = 84_288, max_files: int = 10) -> str:
    """CTEs ending in ``name``(project_id, batch_no, place, path, size, attack_score)."""
    def cell(f: str) -> str:
        return f"{{'took': {_EMPTY}, 'rest': [{f}], 'left': 0::bigint}}"

    fold = (f"list_reduce(todo, lambda a, x: case when len(a.took) < {max_files} and x.rest[1].size <= a.left "
            "then {'took': list_append(a.took, x.rest[1]), 'rest': a.rest, 'left': a.left - x.rest[1].size} "
            "else {'took': a.took, 'rest': list_append(a.rest, x.rest[1]), 'left': a.left} end, "
            f"{{'took': {_EMPTY}, 'rest': {_EMPTY}, 'left': {budget}::bigint}})")
    file = "{'path': path, 'size': size::bigint, 'score': attack_score}"
    return f"""
{name}_run(project_id, batch_no, todo, took) as (
  select project_id, 0, list({cell(file)} order by {order}), {_EMPTY} from ({source}) where size <= {budget} group by project_id
  union all
  select project_id, batch_no + 1, list_transform(st.rest, lambda f: {cell('f')}), st.took from (
    select project_id, batch_no, {fold} as st from {name}_run where len(todo) > 0 and (batch_no = 0 or len(took) > 0){f' and batch_no < {batches}' if batches else ''})),
{name} as (select project_id, cast(batch_no as int) as batch_no, cast(place as int) as place, f.path as path, f.size as size, round(f.score, 2) as attack_score
  from (select project_id, batch_no, unnest(took) as f, generate_subscripts(took, 1) as place from {name}_run))"""


def tokens(name: str, focus: int, reaudit: str) -> str:
    return (f"select p.*, cast(floor(u.used / 4 + 0.5) as bigint) + 6800 + {focus} as est_tokens, {reaudit} as is_reaudit from {name} p "
            f"join (select project_id, batch_no, sum(size) as used from {name} group by all) u using (project_id, batch_no)")


def batches_sql() -> dict[str, str]:
    first = f"with recursive {FEATS},{pack_cte('pk', 'select * from feats', 'attack_score desc, path', None)}"
    both = "select *, 0 as turn from targets union all select *, 1 from neighbours"
    again = pack_cte("ag", both, "turn, attack_score desc, path", 1)
    unseen = "select * from feats where attack_score > 0.1 and (project_id, path) not in (select (project_id, path) from seen)"
    fresh = pack_cte("fr", unseen, "attack_score desc, path", None)
    nxt = (f"recursive {STRONG},{again},{fresh},\nbatches as (select * replace (0 as batch_no) from ({tokens('ag', 800, 'true')}) "
           f"union all select * from ({tokens('fr', 0, 'false')}))")
    return {
        "pack_initial": f"{first} {tokens('pk', 0, 'false')}",
        "batch_tokens": f"{first} select distinct project_id, batch_no, est_tokens from ({tokens('pk', 0, 'false')})",
        "pack_unplaced": f"{first} select project_id, path, cast(size as bigint) as size, 'over budget' as reason from feats "
                         "where (project_id, path) not in (select (project_id, path) from pk)",
        "pack_empty": f"{first} select project_id, cast(coalesce(max(batch_no), 0) + 1 as int) as batch_no from "
                      "(select distinct project_id from feats where size > 84288) left join pk using (project_id) group by project_id",
        "join_summarized": f"{first} select b.project_id, b.batch_no, count(*) as n_summaries from (select distinct project_id, batch_no from pk) b "
                           "join feats f on f.project_id = b.project_id where (b.project_id, b.batch_no, f.path) not in (select (project_id, batch_no, path) from pk) group by all",
        "pack_suspicion": f"with recursive {STRONG},{again} {tokens('ag', 800, 'true')}",
        "pack_next_pass": f"with {nxt} select * from batches",
        "prompt_dataset": _prompt_sql(nxt),
    }


def _prompt_sql(nxt: str) -> str:
    block = scan_sql()["lead_block"]
    context = vector_sql()["retrieve_format"]
    return f"""with {nxt},
heads as (select project_id, batch_no, bool_or(is_reaudit) as again from batches group by all),
ctx as (select 'src' || query_id as project_id, context from ({context})),
led as (select * from ({block})),
strong as (select * from notes where confidence >= 0.7),
map_rows as ({packing_sql()["render_map"]}),
scores as (select project_id, path, attack_score from feats group by all),
map_pages as (select project_id, (rn - 1) // 256 + 1 as place, string_agg(text, chr(10) order by rn) as text from (select m.project_id, m.text,
    row_number() over (partition by m.project_id order by m.part, coalesce(s.attack_score, 0) desc, m.path, m.sub, m.pass_no, m.text) as rn
    from map_rows m left join scores s on s.project_id = m.project_id and s.path = m.path) group by all),
parts as (
  select project_id, batch_no, 1 as section, 0 as place, '' as path, '=== PROTOCOL MAP ===' as text from heads where project_id in (select project_id from map_rows)
  union all select project_id, batch_no, 1, place, '', text from heads join map_pages using (project_id)
  union all select project_id, batch_no, 2 as section, 0 as place, '' as path, '=== SECURITY CONTEXT ===' || chr(10) || context as text from heads join ctx using (project_id)
  union all select project_id, batch_no, 3, 0, '', block from heads join led using (project_id)
  union all select project_id, batch_no, 4, 0, '', '=== PASS 2 FOCUS — INVESTIGATE THESE SPECIFICALLY ===' from heads where again
  union all select h.project_id, batch_no, 4, 1, target_file, '• ' || target_file || case when target_function is not null then ' → ' || target_function else '' end
    || chr(10) || '  Reason: ' || reason || ' [confidence: ' || confidence || ']' from heads h join strong n on n.project_id = h.project_id where again
      and exists (select 1 from feats f where f.project_id = n.project_id and {MATCH})
  union all select project_id, batch_no, 4, 2, '', 'These were flagged in a previous pass. Prioritize them.' from heads where again
  union all select project_id, batch_no, 5, 0, '', '=== CONTRACT CODE ===' from heads
  union all select b.project_id, b.batch_no, 5, b.place, b.path, '// ═══ ' || b.path || ' [' || f.language || '] ═══' || chr(10) || f.content
    from batches b join feats f on f.project_id = b.project_id and f.path = b.path)
select project_id, batch_no, section, place, path, md5(text) as text_md5 from parts"""
