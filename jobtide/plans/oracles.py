"""DuckDB SQL for each registered query, written without looking at the Spark plans.

Where Spark aggregates, these rank, scan or order whole histories, so that the two sides
reach their results in different ways.
"""

from jobtide.plans import tables
from jobtide.plans.queries import BUCKET, NAMESPACE, PREFIX, TOOL_VERSION

# Fixed values, written down a second time so that a wrong one in the library shows.
STATE_LIST = ("job_id, remote_uid, resource_version, name, status, started, updated, "
              "workflow_name, secret, archived")
LABEL_ARCHIVED = "workflows.argoproj.io/workflow-archiving-status"
ERROR_TEXT = "Internal server error, please contact the administrator or try again later."
RESULT_FILES = [
    ("EMBL", "embl"), ("FAA", "faa"), ("FAAHypothetical", "hypotheticals.faa"), ("FFN", "ffn"),
    ("FNA", "fna"), ("GBFF", "gbff"), ("GFF3", "gff3"), ("JSON", "json"), ("TSV", "tsv"),
    ("TSVHypothetical", "hypotheticals.tsv"), ("TSVInference", "inference.tsv"),
    ("TXTLogs", "txt"), ("PNGCircularPlot", "png"), ("SVGCircularPlot", "svg")]
INPUT_FILES = [
    ("uploadLinkFasta", "fastadata.fasta"), ("uploadLinkProdigal", "prodigal.tf"),
    ("uploadLinkReplicons", "replicons.tsv")]
AS_OF = tables.AS_OF
EPOCH = "cast('1970-01-01 00:00:00' as timestamp)"
UUID = ("'^([0-9a-fA-F]{32}|H|\\{H\\}|urn:uuid:H)$'"
        .replace("H", "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"))

FEED = f"feed as ({tables.sql(tables.FEED)})"
STATE = f"""{FEED}, state as (select * exclude (rn) from (
    select *, row_number() over (partition by job_id order by seq desc) rn from feed)
    where rn = 1)"""
REQUESTS = f"requests as ({tables.sql(tables.REQUESTS)})"


def _canonical(text: str) -> str:
    digits = f"lower(replace(replace(replace(replace({text}, 'urn:uuid:', ''), '{{', ''), '}}', ''), '-', ''))"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    shaped = " || '-' || ".join(f"substr({digits}, {at}, {n})" for at, n in cuts)
    return f"case when regexp_matches({text}, {UUID}) then {shaped} end"


def _public(phase: str) -> str:
    return (f"case {phase} when 'Pending' then 'INIT' when 'Init' then 'INIT' "
            f"when 'Running' then 'RUNNING' when 'Succeeded' then 'SUCCESSFUL' "
            f"when 'Failed' then 'ERROR' when 'Error' then 'ERROR' end")


def _values(table: list[tuple[str, str]]) -> str:
    return "(values " + ", ".join(f"('{a}', '{b}')" for a, b in table) + ")"


# Lookups

def _lookup(requests: str, keep: str) -> str:
    return f"""
  select {keep}, r.job_id,
    case when s.job_id is null then 'NOT_FOUND' when s.secret <> r.secret then 'UNAUTHORIZED'
      when s.status is null or s.started is null or s.updated is null then 'OMITTED'
      else 'OK' end outcome, s.*
  from {requests} r left join state s on r.job_id = s.job_id"""


def _answers(requests: str = "requests", keep: str = "r.pos") -> str:
    names = keep.replace("r.", "")
    return f"""select {names}, job_id, outcome,
    case when outcome = 'OK' then {_public('status')} end status,
    case when outcome = 'OK' then started end started,
    case when outcome = 'OK' then case when status in ('Error', 'Succeeded', 'Failed')
      then updated else {AS_OF} end end updated,
    case when outcome = 'OK' then name end as name
  from ({_lookup(requests, keep).replace('s.*', 's.status, s.started, s.updated, s.name')})"""


# Snapshot documents

_JSON = "json_extract_string(item, '$.{}')"


def _item_kind(path: str) -> str:
    return f"coalesce(json_type(item, '$.{path}'), 'NULL') not in ('VARCHAR', 'NULL')"


ITEMS = f"""items as ({tables.sql(tables.ITEM_TEXTS)}),
  bodies as (select snapshot, max(ts) snapshot_ts, '{{"items":[' ||
    string_agg(item, ',' order by event_id) || max(tail) body from items group by snapshot),
  docs as (select *, case when json_valid(body) then cast(body as json) end doc from bodies),
  listed as (select snapshot, snapshot_ts, cast(n - 1 as integer) pos, doc,
    json_extract(doc, '$.items[' || (n - 1) || ']') item from docs, generate_series(1, 6) g(n)
    where (doc is null and n = 1) or n <= json_array_length(doc, '$.items')),
  parts as (select *,
    {_JSON.format('metadata.name')} wf, {_JSON.format('metadata.uid')} uid,
    {_JSON.format('metadata.labels.jobid')} jobid, {_JSON.format('metadata.labels.name')} nm,
    {_JSON.format('metadata.labels.secret')} sec,
    json_extract_string(item, '$.metadata.labels."{LABEL_ARCHIVED}"') arch,
    {_JSON.format('status.phase')} phase,
    cast(cast({_JSON.format('status.startedAt')} as timestamptz) as timestamp) st,
    cast(cast({_JSON.format('status.finishedAt')} as timestamptz) as timestamp) fin
    from listed),
  checked as (select *, case when doc is null then 'bad_document'
      when {_item_kind('metadata.name')} then 'bad_name'
      when {_item_kind('metadata.labels.secret')} then 'bad_label'
      when {_item_kind('status.phase')} then 'bad_phase'
      when {_canonical('jobid')} is null then 'bad_jobid'
      when phase not in ('Pending', 'Init', 'Running', 'Succeeded', 'Failed', 'Error')
      then 'unknown_phase' end reason from parts),
  flagged as (select * exclude (reason), reason,
    coalesce(reason in ('bad_document', 'bad_name', 'bad_label', 'bad_phase'), false) unreadable
    from checked),
  flat as (select snapshot, snapshot_ts, pos, {_canonical('jobid')} job_id,
    {_canonical('uid')} remote_uid, cast(null as varchar) resource_version,
    coalesce(nm, 'Unknown name') as name, phase status, st started,
    coalesce(fin, {AS_OF}) updated, wf workflow_name, coalesce(sec, 'Unknown') secret,
    arch is not null archived, sec is null secret_missing from flagged where reason is null)"""
# The same items, each judged by itself.
FILED = ITEMS.replace(ITEMS[ITEMS.index("bodies as ("):ITEMS.index("parts as (")],
                      "listed as (select cast(null as varchar) snapshot, ts snapshot_ts, 0 pos, "
                      "cast(item as json) item, item doc from items),\n  ")
FILED_LIST = "* exclude (snapshot, snapshot_ts, pos)"
PREFIX_CHECKED = f"""{ITEMS}, ranged as (select *,
    min(case when reason is not null and not unreadable then pos end)
      over (partition by snapshot) first_bad,
    bool_or(unreadable) over (partition by snapshot) lost from flagged),
  judged as (select *, case when reason is not null then reason when lost
    then 'snapshot_unreadable' when pos > first_bad then 'after_bad_item' end verdict from ranged)"""

# Change feed: every event sees the last full row before it and is judged by its secret.
FOLD = f"""with feed as ({tables.sql(tables.CHANGES)}),
  based as (select *, max(case when kind in ('INIT', 'SNAPSHOT') then seq end)
    over (partition by job_id order by seq rows between unbounded preceding and current row)
    base_seq from feed),
  judged as (select e.*, e.kind in ('INIT', 'SNAPSHOT') is_full, e.secret = b.secret counts
    from based e left join feed b on b.job_id = e.job_id and b.seq = e.base_seq),
  ends as (select job_id, max(case when is_full then seq end) full_seq,
    max(case when kind = 'DELETE' and counts then seq end) gone_seq,
    max(case when kind = 'START' and counts then seq end) start_seq
    from judged group by job_id)
  select f.job_id, f.remote_uid, f.resource_version, f.name,
    case when s.seq is null then f.status else 'Pending' end status,
    case when s.seq is null then f.started else s.started end started,
    case when s.seq is null then f.updated else s.updated end updated,
    case when s.seq is null then f.workflow_name else s.workflow_name end workflow_name,
    f.secret, f.archived
  from ends e join feed f on f.job_id = e.job_id and f.seq = e.full_seq
  left join feed s on s.job_id = e.job_id and s.seq = e.start_seq and e.start_seq > e.full_seq
  where e.gone_seq is null or e.gone_seq < e.full_seq"""

CLEAN_NAME = "rtrim(substr(regexp_replace({}, '[^0-9a-zA-Z_.]+', '_', 'g'), 1, 63), '_.')"
REGISTERED = """select job_id, cast(null as varchar) remote_uid,
    cast(null as varchar) resource_version, {name} as name, cast(null as varchar) status,
    {none} started, {none} updated, cast(null as varchar) workflow_name, secret,
    false archived from ({source})"""


def _registered(shape) -> str:
    return REGISTERED.format(
        name=CLEAN_NAME.format("name"), none=tables.NO_TIME, source=tables.sql(shape))


def _origin(text: str) -> str:
    host = f"regexp_replace({text}, '^https://', '')"
    return (f"case when regexp_full_match({text}, '[\\x20-\\x7e\\t]*') "
            f"then regexp_replace({host}, '[^0-9a-zA-Z_.]+', '_', 'g') else 'Unknown' end")


# Requests

_BODIES = f"""bodies as ({tables.sql(tables.REQUEST_BODIES)}),
  docs as (select *, case when json_valid(body) then cast(body as json) end doc from bodies),
  pairs as (select request_id, n - 1 pos, json_extract(doc, '$.jobs[' || (n - 1) || ']') p
    from docs, generate_series(1, 2) g(n) where doc is not null),
  typed as (select request_id, pos,
    {_canonical("json_extract_string(p, '$.jobID')")} job_id,
    case when json_type(p, '$.secret') = 'VARCHAR' then json_extract_string(p, '$.secret') end secret
    from pairs),
  good as (select request_id from typed group by request_id
    having bool_and(job_id is not null and secret is not null)),
  accepted as (select request_id, cast(pos as integer) pos, job_id, secret from typed
    where request_id in (select request_id from good))"""

# Starts

_TEXT = ["prodigalTrainingFile", "genus", "species", "strain", "plasmid", "locus", "locusTag"]
_FLAGS = ["completeGenome", "keepContigHeaders", "compliant"]
_ORDER = ["prodigalTrainingFile", "hasReplicons", "translationTable", "completeGenome",
          "keepContigHeaders", "minContigLength", "dermType", "genus", "species", "strain",
          "plasmid", "locus", "locusTag", "compliant"]


def _kind(name: str) -> str:
    return f"json_type(doc, '$.config.{name}')"


def _text(name: str) -> str:
    return f"json_extract_string(doc, '$.config.{name}')"


def _start_problem(name: str) -> str:
    kind = _kind(name)
    if name in _TEXT:
        return f"when coalesce({kind}, 'NULL') not in ('NULL', 'VARCHAR') then 'bad {name}'"
    if name == "dermType":
        return (f"when coalesce({kind}, 'NULL') <> 'NULL' and coalesce({_text(name)}, '') not in "
                f"('UNKNOWN', 'MONODERM', 'DIDERM') then 'bad {name}'")
    missing = f"when {kind} is null then 'missing {name}' "
    if name == "hasReplicons":
        return f"when coalesce({kind}, 'BOOLEAN') <> 'BOOLEAN' then 'bad {name}'"
    if name in _FLAGS:
        return missing + f"when {kind} <> 'BOOLEAN' then 'bad {name}'"
    limit = 255 if name == "translationTable" else 2**64 - 1
    return missing + (f"when {kind} not in ('UBIGINT', 'BIGINT') then 'bad {name}' "
                      f"when try_cast({_text(name)} as hugeint) not between 0 and {limit} "
                      f"then 'bad {name}'")


STARTS = f"""bodies as ({tables.sql(tables.START_BODIES)}),
  docs as (select pos, raw_origin, case when json_valid(body) then cast(body as json) end doc
    from bodies),
  raw as (select *, {_canonical("json_extract_string(doc, '$.job.jobID')")} job_id,
    json_extract_string(doc, '$.job.secret') secret from docs),
  checked as (select *, case when doc is null then 'bad document'
    when job_id is null then 'bad jobID' when secret is null then 'bad secret'
    {' '.join(_start_problem(n) for n in _ORDER)} end reason from raw),
  starts as (select pos, job_id, secret, {_origin('raw_origin')} origin,
    {_text('prodigalTrainingFile')} prodigal_training_file,
    coalesce(cast({_text('hasReplicons')} as boolean), true) has_replicons,
    cast({_text('translationTable')} as smallint) translation_table,
    cast({_text('completeGenome')} as boolean) complete_genome,
    cast({_text('keepContigHeaders')} as boolean) keep_contig_headers,
    {_text('minContigLength')} min_contig_length, {_text('dermType')} derm_type,
    {_text('genus')} genus, {_text('species')} species, {_text('strain')} strain,
    {_text('plasmid')} plasmid, {_text('locus')} locus, {_text('locusTag')} locus_tag,
    cast({_text('compliant')} as boolean) compliant
    from checked where reason is null)"""


def _word(option: str, column: str) -> str:
    return (f"case when {column} <> '' then '{option} ''' || replace({column}, '''', '') "
            f"|| ''' ' else '' end")


PARAMETERS = " || ".join([
    "case when cast(min_contig_length as hugeint) > 1 "
    "then '--min-contig-length ' || min_contig_length || ' ' else '' end",
    "case when prodigal_training_file is not null then '--prodigal /data/prodigal.tf ' else '' end",
    "case when has_replicons then '--replicons /data/replicons.tsv ' else '' end",
    "case when complete_genome then '--complete ' else '' end",
    _word("--locus", "locus"), _word("--locus-tag", "locus_tag"),
    "case when keep_contig_headers then '--keep-contig-headers ' else '' end",
    _word("--genus", "genus"), _word("--species", "species"),
    _word("--strain", "strain"), _word("--plasmid", "plasmid"),
    "case when compliant then '--compliant ' else '' end",
    "case when translation_table = 4 then '--translation-table 4 ' else '' end",
    "'--gram ' || case derm_type when 'MONODERM' then '+' when 'DIDERM' then '-' else '?' end",
])
PLANS = f"""{STARTS}, {STATE}, plans as (select p.pos, p.job_id,
    case when s.job_id is null then 'NOOP' when s.secret <> p.secret then 'UNAUTHORIZED'
      else 'OK' end outcome, 'jobid=' || p.job_id || ',name=' || s.name || ',origin=' || origin
      || ',secret=' || s.secret labels, 'jobid=' || p.job_id a, 'parameter=' || {PARAMETERS} b
    from starts p left join state s on s.job_id = p.job_id)"""

SUBMITTED = f"""answers as ({tables.sql(tables.SUBMIT_RESULTS)}),
  decoded as (select pos, job_id, case when json_valid(body) then cast(body as json) end doc from answers),
  submitted as (select pos, job_id, json_extract_string(doc, '$.metadata.name') nm,
    cast(cast(json_extract_string(doc, '$.metadata.creationTimestamp') as timestamptz) as timestamp)
      created from decoded where json_type(doc, '$.metadata.name') = 'VARCHAR')"""

# Registrations

INITS = f"""bodies as ({tables.sql(tables.INIT_BODIES)}),
  docs as (select *, case when json_valid(body) then cast(body as json) end doc from bodies),
  checked as (select *, json_extract_string(doc, '$.name') as name, case
    when doc is null then 'bad document' when json_type(doc, '$.name') is null then 'missing name'
    when json_type(doc, '$.name') <> 'VARCHAR' then 'bad name'
    when json_type(doc, '$.repliconTableType') is null then 'missing repliconTableType'
    when json_extract_string(doc, '$.repliconTableType') not in ('CSV', 'TSV')
    then 'bad repliconTableType' end reason from docs)"""

# Deletes

DELETES = f"""{STATE}, asked as ({tables.sql(tables.DELETES)}),
  tried as (select a.pos, a.job_id, s.job_id is not null known, coalesce(a.secret = s.secret, false) fits
    from asked a left join state s on s.job_id = a.job_id),
  marked as (select s.*, (select min(pos) from tried t where t.job_id = s.job_id and t.fits) deleted_by
    from state s)"""

# Logs

RAW_LINES = f"""raw_lines as (select {tables.job_sql('conv_id')} job_id, turn,
    {tables.LINE_CONTENT} content, {tables.BLANK_LINE} is_blank, {tables.BROKEN_LINE} is_broken
    from conversations)"""
KEPT_LINES = f"""{RAW_LINES}, kept as (select * from raw_lines
    where not is_blank and not is_broken and not contains(content, 'argo=true'))"""
SOURCE = """case when status = 'Error' then 'ERROR_TEXT'
    when archived and remote_uid is not null then 'ARCHIVED' when archived then 'NONE'
    when workflow_name is not null then 'LINES' else 'NONE' end"""


def _result_answers(ready: str) -> str:
    return f"""select pos, job_id, outcome,
    case when outcome = 'OK' then coalesce(started, {EPOCH}) end started,
    case when outcome = 'OK' then coalesce(updated, {EPOCH}) end updated,
    case when outcome = 'OK' then name end as name
  from (select r.pos, r.job_id, case when s.job_id is null then 'NOT_FOUND'
      when s.secret <> r.secret then 'UNAUTHORIZED' when {ready} then 'OK'
      else 'NOT_FINISHED' end outcome, s.started, s.updated, s.name
    from requests r left join state s on s.job_id = r.job_id)"""


LOOSE = "s.status is null or s.status = 'Succeeded'"
STRICT = "coalesce(s.status = 'Succeeded', false)"


def _encoded(text: str) -> str:
    return (f"replace(replace(url_encode('attachment; filename=\"' || {text} || '\"'), "
            f"'%20', '+'), '~', '%7E')")


_LATEST = f"with {STATE} select {STATE_LIST} from state"

ORACLES = {
    "latest_state": _LATEST,
    "stream_state": _LATEST,
    "fold_changes": FOLD,
    "live_state": FOLD,
    "stream_fold": FOLD,
    "register_jobs": _registered(tables.INITS),
    "init_scan": f"with {INITS} " + REGISTERED.format(
        name=CLEAN_NAME.format("name"), none=tables.NO_TIME,
        source="select * from checked where reason is null"),
    "init_rejects": f"with {INITS} select job_id, body, reason from checked where reason is not null",
    "upsert_state": f"""with {STATE}, new as ({_registered(tables.NEW_JOBS)})
  select {STATE_LIST} from new union all
  select {STATE_LIST} from state where job_id not in (select job_id from new)""",
    "tombstoned_state": f"""with {STATE}, dead as ({tables.sql(tables.TOMBSTONES)})
  select job_id, secret, arrived snapshot_ts from state s where not exists (
    select 1 from dead d where d.job_id = s.job_id and d.secret = s.secret
      and d.deleted_at >= s.arrived)""",
    "flatten_state": f"with {ITEMS} select * from flat",
    "flatten_landed": f"with {ITEMS} select * from flat",
    "state_rejects": f"""with {ITEMS} select snapshot, pos, reason, unreadable
  from flagged where reason is not null""",
    "prefix_policy": f"""with {PREFIX_CHECKED} select snapshot, pos,
    {_canonical('jobid')} job_id, phase status from judged where verdict is null""",
    "prefix_rejects": f"""with {PREFIX_CHECKED} select snapshot, pos, verdict reason, unreadable
  from judged where verdict is not null""",
    "snapshot_state": f"""with {ITEMS} select {STATE_LIST} from (select *, row_number() over (
    partition by job_id order by snapshot_ts desc, snapshot desc, pos desc) rn from flat)
  where rn = 1""",
    "snapshot_files": f"with {FILED} select {FILED_LIST} from flat",
    "poll_state": f"""with {FILED} select {STATE_LIST} from (select *, row_number() over (
    partition by job_id order by started desc, workflow_name desc) rn from flat) where rn = 1""",
    "request_files": f"with {_BODIES} select pos, job_id, secret from accepted",
    "request_scan": f"with {_BODIES} select * from accepted",
    "request_rejects": f"""with {_BODIES} select request_id, body,
    case when doc is null then 'bad_list' else 'bad_job' end reason from docs
  where request_id not in (select request_id from good)""",
    "job_lookup": f"with {STATE}, {REQUESTS} {_answers()}",
    "lookup_found": f"""with {STATE}, {REQUESTS} select * exclude (outcome)
  from ({_answers()}) where outcome = 'OK'""",
    "lookup_failed": f"""with {STATE}, {REQUESTS} select pos, job_id, outcome status
  from ({_answers()}) where outcome in ('NOT_FOUND', 'UNAUTHORIZED')""",
    "public_state": f"""with {STATE} select job_id, {_public('status')} status, started, updated,
    name from state where status is not null and started is not null and updated is not null""",
    "request_lookup": f"with {STATE}, {_BODIES} {_answers('accepted', 'r.request_id, r.pos')}",
    "delete_outcomes": f"""with {DELETES}, ordered as (select *, coalesce(bool_or(fits) over (
      partition by job_id order by pos rows between unbounded preceding and 1 preceding), false)
      gone from tried)
  select pos, job_id, case when not known or gone or fits then 'OK' else 'UNAUTHORIZED' end outcome,
    known and fits and not gone removed from ordered""",
    "delete_remaining": f"with {DELETES} select {STATE_LIST} from marked where deleted_by is null",
    "delete_targets": f"""with {DELETES} select job_id, deleted_by, case when archived then
    '/api/v1/archived-workflows/' || remote_uid else
    '/api/v1/workflows/{NAMESPACE}/' || workflow_name end delete_path
  from marked where deleted_by is not null""",
    "config_scan": f"with {STARTS} select * from starts",
    "config_rejects": f"with {STARTS} select pos, reason from checked where reason is not null",
    "job_parameters": f"with {STARTS} select pos, job_id, {PARAMETERS} parameters from starts",
    "submission_manifest": f"""with {PLANS} select pos, job_id, outcome,
    case when outcome = 'OK' then '{NAMESPACE}' end namespace,
    case when outcome = 'OK' then 'WorkflowTemplate' end resource_kind,
    case when outcome = 'OK' then '{PREFIX}-{TOOL_VERSION}' end resource_name,
    case when outcome = 'OK' then '{PREFIX}-' || job_id || '-' end generate_name,
    case when outcome = 'OK' then labels end labels,
    case when outcome = 'OK' then a || chr(10) || b end parameters from plans""",
    "submission_documents": f"""with {PLANS} select job_id,
    '{{"namespace":"{NAMESPACE}","resourceKind":"WorkflowTemplate","resourceName":'
    || '"{PREFIX}-{TOOL_VERSION}","submitOptions":{{"labels":"' || labels || '","parameters":["'
    || a || '","' || b || '"],"serviceAccount":null,"generateName":"{PREFIX}-' || job_id || '-"}}}}' body
  from plans where outcome = 'OK'""",
    "submit_results": f"""with {SUBMITTED} select pos, job_id, nm as name, created creation_timestamp
  from submitted""",
    "apply_submissions": f"""with {STATE}, {SUBMITTED}, results as (select *, row_number() over (
      partition by job_id order by pos desc) rn from submitted)
  select s.job_id, remote_uid, resource_version, name, case when r.nm is null then status
    else 'Pending' end status, coalesce(r.created, started) started,
    case when r.nm is null then updated else {AS_OF} end updated,
    coalesce(r.nm, workflow_name) workflow_name, secret, archived
  from state s left join results r on r.job_id = s.job_id and r.rn = 1""",
    "log_lines": f"""with {KEPT_LINES} select job_id, cast(0 as bigint) part, turn line_no, content
  from kept""",
    "broken_logs": f"with {RAW_LINES} select distinct job_id from raw_lines where is_broken",
    "log_chunks": f"""with {KEPT_LINES}, cut as (select *, turn // 2 chunk, coalesce(sum(
      octet_length(encode(content)) + 1) over (partition by job_id, turn // 2 order by turn
      rows between unbounded preceding and 1 preceding), 0) before from kept)
  select job_id, cast(0 as bigint) part, chunk, cast(before // 400 as bigint) section,
    string_agg(content || chr(10), '' order by turn) as text from cut group by all""",
    "log_paths": f"""with {STATE} select job_id, {SOURCE} source, case {SOURCE}
    when 'ARCHIVED' then '/artifact-files/{NAMESPACE}/archived-workflows/' || remote_uid || '/' ||
      coalesce(workflow_name, '') || '/outputs/main-logs'
    when 'LINES' then '/api/v1/workflows/{NAMESPACE}/' || workflow_name ||
      '/log?logOptions.container=main' end log_path from state s""",
    "log_routing": f"""with {STATE}, {REQUESTS} select pos, job_id, outcome, source,
    case source when 'ERROR_TEXT' then '{ERROR_TEXT}' when 'NONE' then '' end as text
  from (select r.pos, r.job_id, case when s.job_id is null then 'NOT_FOUND'
      when s.secret <> r.secret then 'UNAUTHORIZED' else 'OK' end outcome,
      case when s.secret = r.secret then {SOURCE} end source
    from requests r left join state s on s.job_id = r.job_id)""",
    "job_logs": f"""with {STATE}, {REQUESTS}, {KEPT_LINES},
  wanted as (select job_id, {SOURCE} source from state s where exists (
    select 1 from requests r where r.job_id = s.job_id and r.secret = s.secret)),
  told as (select w.job_id, (select string_agg(content || chr(10), '' order by turn) from kept k
      where k.job_id = w.job_id) body, exists (select 1 from raw_lines l
      where l.job_id = w.job_id and is_broken) log_error from wanted w where source = 'LINES'),
  stored as (select w.job_id, d.text body from wanted w left join documents d
      on {tables.job_sql('d.doc_id')} = w.job_id where w.source = 'ARCHIVED')
  select job_id, cast(0 as bigint) part, cast(0 as bigint) chunk, cast(0 as bigint) section,
    case when not log_error then coalesce(body, '') end as text, log_error from told
  union all select job_id, 0, 0, 0, coalesce(body, ''), false from stored""",
    "result_answers": f"with {STATE}, {REQUESTS} {_result_answers(LOOSE)}",
    "result_answers_strict": f"with {STATE}, {REQUESTS} {_result_answers(STRICT)}",
    "result_manifest": f"""with {STATE}, {REQUESTS} select pos, job_id, started, updated, name, kind,
    'jobs/' || job_id || '/results/result.' || ext as key, name || '.' || ext filename
  from ({_result_answers(LOOSE)}), {_values(RESULT_FILES)} f(kind, ext) where outcome = 'OK'""",
    "result_urls": f"""with {STATE}, {REQUESTS}, files as (select pos, kind,
    'jobs/' || job_id || '/results/result.' || ext as key, name || '.' || ext filename
  from ({_result_answers(LOOSE)}), {_values(RESULT_FILES)} f(kind, ext) where outcome = 'OK')
  select pos, kind, filename, 'https://{BUCKET}.s3.example.org/' || key || '?response-content-disposition='
    || {_encoded('filename')} url from files""",
    "upload_manifest": f"""with files as (select job_id, link, 'jobs/' || job_id || '/inputs/' || file
    as key from ({tables.sql(tables.INITS)}), {_values(INPUT_FILES)} f(link, file))
  select *, 'http://{BUCKET}.s3.example.org/' || key url from files""",
    "status_map": f"""select event_id, phase, known, {_public('known')} status,
    coalesce(known in ('Error', 'Succeeded', 'Failed'), false) terminal,
    known is null or known = 'Succeeded' ready, coalesce(known = 'Succeeded', false) finished
  from (select event_id, coalesce({tables.PHASE}, event_type) phase, {tables.PHASE} known
    from events)""",
    "name_cleanup": f"select doc_id, {CLEAN_NAME.format('text')} as name from documents",
    "origin_cleanup": f"select page_id, {_origin('url')} origin, {_origin('html')} html_origin from pages",
    "quoted_text": """select doc_id, '''' || replace(text, '''', '') || '''' quoted from documents""",
    "uuid_forms": f"""select event_id, raw, {_canonical('raw')} canonical
  from (select event_id, {tables.UUID_FORMS} raw from events)""",
    "time_forms": f"""select event_id, {tables.TIME_FORMS} raw, case event_type
    when 'click' then ts when 'view' then ts - interval '2' hour
    when 'error' then date_trunc('second', ts) + interval '330' minute
    when 'purchase' then case when value >= 20
      then date_trunc('second', ts) + interval '123456' microsecond end end instant from events""",
    "label_strings": """select c_custkey, concat('key=', c_custkey, ',name=', c_name, ',segment=',
    c_mktsegment) labels, concat('key=', c_custkey, chr(10), 'name=', c_name, chr(10),
    'segment=', c_mktsegment) parameters from customer""",
    "download_headers": f"select page_id, {_encoded('url')} disposition from pages",
}
# The same results from tables stored by job.
ORACLES |= {"upsert_stored": ORACLES["upsert_state"], "lookup_stored": ORACLES["job_lookup"],
         "job_logs_stored": ORACLES["job_logs"]}


ORACLES["answer_files"] = f"""with {STATE}, {REQUESTS}, answers as ({_answers()}),
  placed as (
    select case when outcome = 'OK' then 'jobs' else 'failedJobs' end list, pos // 10000 as "range",
      pos, job_id, case when outcome = 'OK' then status else outcome end "jobStatus", started, updated, name
    from answers where outcome <> 'OMITTED')
  select list, "range", row_number() over (partition by list, "range" order by pos) - 1 line_no,
    pos, job_id "jobID", "jobStatus", started, updated, name from placed"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
