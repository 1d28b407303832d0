"""Test tables read as job data.

Each view is one table and a list of SQL expressions that mean the same in Spark and in
DuckDB, so that both sides of a check start from equal rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uuid_sql(seed: str, shaped: bool = True) -> str:
    """A stable UUID per seed; plain hex if not ``shaped``."""
    digest = f"md5({seed})"
    if not shaped:
        return digest
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "concat(" + ", '-', ".join(f"substr({digest}, {at}, {n})" for at, n in cuts) + ")"


def job_sql(number: str, shaped: bool = True) -> str:
    return uuid_sql(f"concat('job ', cast({number} as string))", shaped)


AS_OF = "cast('2024-02-01 00:00:00' as timestamp)"
NO_TIME = "cast(null as timestamp)"
USER_SECRET = "concat('s', cast(user_id as string))"
ORDER_JOB = "cast(floor(o_custkey / 7.5) as bigint)"
CUSTOMER_JOB = "cast(floor(c_custkey / 7.5) as bigint)"
PART_JOB = "cast(floor(p_partkey / 10.0) as bigint)"
RUN_UID = uuid_sql("concat('run ', cast(event_id as string))")

PHASE = """case when event_type = 'error' and value < 10 then 'Error'
  when event_type = 'error' then 'Failed' when event_type = 'purchase' then 'Succeeded'
  when event_type = 'click' then 'Running' when event_type = 'view' and value < 20 then 'Init'
  when event_type = 'view' then 'Pending' end"""

# Whole job rows: a signup is a job just registered, any other event a snapshot row.
FEED = ("events", [
    "event_id as seq",
    "cast(ts as timestamp) as arrived",
    f"{job_sql('user_id')} as job_id",
    f"case when event_type <> 'signup' then {RUN_UID} end as remote_uid",
    "case when event_type <> 'signup' then cast(event_id as string) end as resource_version",
    "concat('sample_', cast(user_id as string)) as name",
    f"{PHASE} as status",
    "case when event_type <> 'signup' then cast(ts as timestamp) end as started",
    f"""case when event_type in ('error', 'purchase') then cast(ts as timestamp) + interval '1' hour
        when event_type <> 'signup' then {AS_OF} end as updated""",
    """case when event_type <> 'signup' then concat('wf-', cast(event_id as string)) end
        as workflow_name""",
    f"{USER_SECRET} as secret",
    "event_type in ('purchase', 'error') and value >= 30 as archived",
])

# A change feed with every kind of event. Some secrets change or are wrong.
CHANGES = ("events", [
    "event_id as seq",
    """case when event_type = 'signup' then 'INIT' when event_type = 'click' then 'START'
        when event_type = 'error' then 'DELETE' else 'SNAPSHOT' end as kind""",
    f"{job_sql('user_id')} as job_id",
    f"case when event_type in ('view', 'purchase') then {RUN_UID} end as remote_uid",
    """case when event_type in ('view', 'purchase') then cast(event_id as string) end
        as resource_version""",
    """case when event_type in ('signup', 'view', 'purchase')
        then concat('sample_', cast(event_id as string)) end as name""",
    f"case when event_type in ('view', 'purchase') then {PHASE} end as status",
    """case when event_type in ('view', 'purchase', 'click') then cast(ts as timestamp) end
        as started""",
    """case when event_type in ('view', 'purchase', 'click')
        then cast(ts as timestamp) + interval '1' hour end as updated""",
    """case when event_type in ('view', 'purchase', 'click')
        then concat('wf-', cast(event_id as string)) end as workflow_name""",
    f"""case when event_type in ('click', 'error') and value < 12 then 'bad'
        when value < 3 then 'Unknown' else {USER_SECRET} end as secret""",
    "event_type = 'purchase' and value >= 30 as archived",
])

REQUESTS = ("orders", [
    "o_orderkey as pos",
    f"{job_sql(ORDER_JOB)} as job_id",
    f"""case when o_orderstatus = 'P' then 'bad'
        else concat('s', cast({ORDER_JOB} as string)) end as secret""",
])

DELETES = ("customer", [
    "c_custkey as pos",
    f"{job_sql(CUSTOMER_JOB)} as job_id",
    f"""case when c_mktsegment = 'BUILDING' and c_nationkey < 10
        then concat('s', cast({CUSTOMER_JOB} as string)) else 'bad' end as secret""",
])

INITS = ("customer", [
    f"{job_sql('c_custkey')} as job_id",
    "concat('k', cast(c_custkey as string)) as secret",
    "concat(c_name, ' / ', c_mktsegment, ' (', cast(c_nationkey as string), ')..') as name",
])

INIT_BODIES = ("customer", [
    f"{job_sql('c_custkey')} as job_id",
    "concat('k', cast(c_custkey as string)) as secret",
    """concat('{"name":', case when c_nationkey = 1 then 'null' else
        concat('"', c_name, ' / ', c_mktsegment, '"') end,
        case when c_nationkey = 2 then '' when c_nationkey = 3 then ',"repliconTableType":"csv"'
          when c_acctbal < 0 then ',"repliconTableType":"TSV"'
          else ',"repliconTableType":"CSV"' end,
        case when c_nationkey = 4 then '' else '}' end) as body""",
])

NEW_JOBS = ("supplier", [
    f"{job_sql('s_suppkey * 2')} as job_id",
    "concat('k', cast(s_suppkey as string)) as secret",
    "concat(s_name, ' !') as name",
])

TOMBSTONES = ("customer", [
    f"{job_sql(CUSTOMER_JOB)} as job_id",
    f"""case when c_mktsegment = 'BUILDING' then concat('s', cast({CUSTOMER_JOB} as string))
        else 'bad' end as secret""",
    """cast(concat('2024-01-', lpad(cast(c_nationkey + 6 as string), 2, '0'), ' 00:00:00')
        as timestamp) as deleted_at""",
])

SUBMIT_RESULTS = ("customer", [
    "c_custkey as pos",
    f"{job_sql('cast(floor(c_custkey / 12.0) as bigint)')} as job_id",
    """concat('{"metadata":{', case when c_mktsegment = 'FURNITURE' then '' else
        concat('"name":', case when c_custkey % 31 = 3 then '5' else
          concat('"wf-', cast(c_custkey as string), '"') end, ',') end,
        '"creationTimestamp":"2024-01-', lpad(cast(c_nationkey + 1 as string), 2, '0'),
        case when c_acctbal < 0 then 'T10:00:00+02:00' else 'T10:00:00Z' end, '"}}',
        case when c_custkey % 37 = 4 then ' x' else '' end) as body""",
])

# Snapshot items as text, six to a document, several of them faulty. Some documents have
# no end, some go on after it.
ITEM_TEXTS = ("events", [
    "concat('s', lpad(cast(cast(floor(event_id / 6.0) as bigint) as string), 9, '0')) as snapshot",
    "cast(ts as timestamp) as ts",
    "event_id",
    """case cast(floor(event_id / 6.0) as bigint) % 23 when 5 then '' when 9 then ']} more'
        else ']}' end as tail""",
    f"""concat('{{"metadata":{{"name":',
        case when event_id % 101 = 7 then '5' else concat('"wf-', cast(event_id as string), '"') end,
        ',"uid":"', {uuid_sql("concat('run ', cast(event_id as string))", shaped=False)},
        '","labels":{{"jobid":"',
        case when event_type = 'click' then concat('urn:uuid:', {job_sql('user_id')})
          when event_type = 'view' then concat('{{', {job_sql('user_id')}, '}}')
          when event_type = 'error' then upper({job_sql('user_id', shaped=False)})
          when value < 2 then 'nope' else {job_sql('user_id')} end, '"',
        case when event_id % 103 = 9 then ',"secret":7'
          when value < 40 then concat(',"secret":"s', cast(user_id as string), '"') else '' end,
        case when value >= 30 then ',"workflows.argoproj.io/workflow-archiving-status":"Done"'
          else '' end,
        '}}}},"status":{{"phase":',
        case when event_id % 107 = 11 then '1' else concat('"', coalesce({PHASE}, 'Waiting'), '"') end,
        ',"startedAt":"', replace(substr(cast(ts as string), 1, 19), ' ', 'T'),
        case when event_type = 'click' then '+02:00' else 'Z' end,
        '","finishedAt":', case when event_type in ('error', 'purchase')
          then concat('"', replace(substr(cast(ts as string), 1, 19), ' ', 'T'), 'Z"')
          else 'null' end, '}}}}') as item""",
])

REQUEST_BODIES = ("orders", [
    "concat('r', cast(o_orderkey as string)) as request_id",
    f"""concat('{{"jobs":[{{"secret":', case when o_orderpriority = '1-URGENT' and
        o_orderstatus = 'P' then '7' else concat('"s', cast({ORDER_JOB} as string), '"') end,
        ',"jobID":"', {job_sql(ORDER_JOB)}, '"}},{{"secret":"bad","jobID":"',
        case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then 'none'
          else concat('urn:uuid:', {job_sql('o_orderkey')}) end, '"}}]',
        case when o_orderpriority = '2-HIGH' and o_orderstatus = 'P' then '' else '}}' end)
        as body""",
])

START_BODIES = ("part", [
    "p_partkey as pos",
    """case when p_size <> 5 then concat('https://', p_name, '.example/', p_brand) end
        as raw_origin""",
    f"""concat('{{"job":{{"secret":"', case when p_size between 43 and 46 then 'bad' else
        concat('s', cast({PART_JOB} as string)) end, '","jobID":"',
        case when p_size = 41 then 'nope' else {job_sql(PART_JOB)} end, '"}},"config":{{',
        '"translationTable":', case when p_size <= 10 then '4' when p_size = 49 then '"11"'
          when p_size = 48 then '11.5' else cast(p_size * 6 as string) end,
        ',"completeGenome":', case when p_brand < 'Brand#2' then 'true' else 'false' end,
        ',"keepContigHeaders":', case when p_size = 47 then '1'
          when p_name < 'hot' then 'true' else 'false' end,
        ',"minContigLength":', case when p_size = 20 then '18446744073709551615'
          when p_size = 21 then '-1' when p_size = 22 then '18446744073709551616'
          else cast(p_size - 1 as string) end,
        case when p_size = 30 then '' when p_size > 25 then ',"compliant":true'
          else ',"compliant":false' end,
        case when p_type = 'ECONOMY' then '' when p_size = 31 then ',"hasReplicons":null'
          else ',"hasReplicons":false' end,
        case when p_size = 32 then ',"dermType":"OTHER"' when p_type = 'SMALL' then
          ',"dermType":"DIDERM"' when p_type = 'ECONOMY' then ',"dermType":"MONODERM"'
          when p_size > 12 then ',"dermType":null' else '' end,
        ',"genus":"', p_name, '","species":', case when p_size = 33 then '""'
          when p_size = 34 then '"''"' else concat('"o''', p_type, '"') end,
        ',"strain":"', p_brand, '"',
        case when p_size < 8 then ',"locus":"L 1","plasmid":"p1"' else '' end,
        case when p_size = 35 then ',"locusTag":5' when p_size = 36 then ',"locusTag":"T"'
          else '' end,
        case when p_size between 36 and 40 then ',"prodigalTrainingFile":""'
          when p_size = 7 then ',"prodigalTrainingFile":"x.trn"' else '' end,
        '}}}}', case when p_size = 29 then ' x' else '' end) as body""",
])

# The accepted spellings of a UUID, and some that are not.
UUID_FORMS = f"""case when event_type = 'click' then concat('urn:uuid:', {job_sql('user_id')})
    when event_type = 'view' then concat('{{', {job_sql('user_id')}, '}}')
    when event_type = 'error' then upper({job_sql('user_id', shaped=False)})
    when event_type = 'signup' then upper({job_sql('user_id')})
    when value < 20 then concat('{{', {job_sql('user_id')}) when value < 60
    then concat('-', {job_sql('user_id')}) else {job_sql('user_id')} end"""

# Timestamps with and without offsets, fractions and separators.
TIME_FORMS = """case when event_type = 'click' then concat(cast(ts as string), 'Z')
    when event_type = 'view' then concat(replace(cast(ts as string), ' ', 'T'), '+02:00')
    when event_type = 'error' then concat(substr(cast(ts as string), 1, 19), '-0530')
    when event_type = 'signup' then replace(cast(ts as string), ' ', 'T')
    when value < 20 then substr(cast(ts as string), 1, 10)
    else concat(replace(substr(cast(ts as string), 1, 19), ' ', 'T'), '.123456789z') end"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, shape: tuple[str, list[str]]) -> DataFrame:
    table, columns = shape
    return read(spark, sf_dir, table).selectExpr(*columns)


def sql(shape: tuple[str, list[str]]) -> str:
    table, columns = shape
    return f"select {', '.join(columns)} from {table}"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as enveloped log lines; some are blank, some are malformed."""
    return read(spark, sf_dir, "conversations").selectExpr(
        f"{job_sql('conv_id')} as job_id",
        "cast(0 as bigint) as part",
        "turn as line_no",
        f"""case when {BLANK_LINE} then ' \t\r' when {BROKEN_LINE} then '{{"result":{{"content":5}}}}'
            else to_json(named_struct('result', named_struct('content', {LINE_CONTENT}))) end
            as line""",
    )


LINE_CONTENT = "case when role = 'system' then concat('time argo=true ', text) else text end"
BLANK_LINE = "role = 'user' and turn = 4"
BROKEN_LINE = "role = 'assistant' and turn = 5 and length(text) < 300"


def archived_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archived logs, whole texts cut at their newlines."""
    texts = read(spark, sf_dir, "documents").selectExpr(
        f"{job_sql('doc_id')} as job_id", "cast(0 as bigint) as part", "text",
        r"split(regexp_replace(text, '\\n\\z', ''), '\\n', -1) as lines")
    return texts.selectExpr(
        "job_id", "part", "text", "size(lines) as n", "posexplode(lines) as (line_no, line)",
    ).selectExpr(
        "job_id", "part", "cast(line_no as bigint) as line_no", "line",
        r"line_no = n - 1 and not endswith(text, '\n') as open_ended")


def write_snapshots(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``ITEM_TEXTS`` as snapshot files of 600 items, one document per file.

    Tasks put their many files in place themselves, as the driver would move them one by one.
    """
    documents = view(spark, sf_dir, ITEM_TEXTS).groupBy(F.floor(F.col("event_id") / 600).alias("poll")).agg(
        F.expr("""concat('{"items":[', listagg(item, ',') within group (order by event_id), ']}')""").alias("body"))
    (documents.select("body").write.option("maxRecordsPerFile", 1)
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path))


def write_requests(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``REQUEST_BODIES`` as files of one body per line."""
    view(spark, sf_dir, REQUEST_BODIES).select("body").write.text(path)


def snapshot_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ITEM_TEXTS`` packed into documents."""
    return view(spark, sf_dir, ITEM_TEXTS).groupBy("snapshot").agg(
        F.max("ts").alias("snapshot_ts"),
        F.expr("""concat('{"items":[', listagg(item, ',') within group (order by event_id),
            max(tail))""").alias("body"))
