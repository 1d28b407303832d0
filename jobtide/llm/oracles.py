"""DuckDB SQL for the queries here that SQL can express."""

_URL = r"""select page_id, coalesce(url, '') as u, instr(coalesce(url, ''), '://') as cut_at from pages"""

OP3 = rf"""
with raw as ({_URL}),
cut as (select page_id, u, case when cut_at = 0 then '' else substr(u, cut_at + 3) end as rest from raw),
parts as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
    regexp_extract(rest, '^[^/?#]*((?s).*)$', 1) as tail
  from cut),
listed as (select * from (values ('net/', 'net', '/', 'block'),
  ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'),
  ('org/fr/', 'org', '/fr/', 'allow')) as r(rule, site, prefix, verdict)),
fits as (
  select p.page_id, arg_max(l.rule, length(l.rule)) as rule,
    arg_max(l.verdict, length(l.rule)) as verdict
  from parts p join listed l on (p.host = l.site or ends_with(p.host, '.' || l.site))
    and starts_with(p.path, l.prefix)
  group by p.page_id)
select p.page_id, p.host, p.path, f.rule,
  case when f.verdict is not null then f.verdict
    when regexp_matches(p.host || p.tail, '^([^/?#]*\.)?adserver\.')
      or regexp_matches(p.host || p.tail, '^([^/?#]*\.)?doubleclick\.[a-z]+(/|$)')
      or regexp_matches(p.host || p.tail, '^[^/?#]*/([^?#]*/)?ads/')
      or regexp_matches(p.host || p.tail, '/banner/[^?#]*\.(gif|png|jpg)')
      or regexp_matches(p.host || p.tail, '/(pixel|beacon)\.gif')
      or regexp_matches(p.host || p.tail, '^[^/?#]*/cgi-bin/')
      or regexp_matches(p.host || p.tail, '^[^/?#]*/([^?#]*/)?login(\.[a-z]+)?([?]|$)')
      or regexp_matches(p.host || p.tail, '[?&]date=[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
    then 'block' else 'allow' end as verdict
from parts p left join fits f on p.page_id = f.page_id
"""

_SPACE = r"[ \t\n\x0b\f\r]"
_PHRASES = ("(all rights reserved|cookie policy|enable javascript|lorem ipsum|privacy policy"
            "|subscribe to our newsletter|terms of service|terms of use)")
# A line's end, also before a last mark that ends lines.
_END = r"[\r\x{85}\x{2028}\x{2029}]?$"
_MARKS = (r"[\x{964}\x{965}\x{6d4}\x{61f}\x{3002}\x{ff0e}\x{ff61}\x{ff01}\x{ff1f}\x{1362}\x{1367}\x{1368}"
          r"\x{589}\x{17d4}\x{17d5}\x{104b}\x{f0d}\x{1803}\x{1809}\x{df4}]")
_SENTENCE = rf"""[.!?…]["''»”)\]]*({_SPACE}|{_END})|{_MARKS}|[\x{{e01}}-\x{{eff}}]{{20}}"""
_SEVERAL = (rf"([^ \t\n\x0b\f\r]+{_SPACE}+){{3}}[^ \t\n\x0b\f\r]"
            r"|[\x{e01}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{2e80}-\x{d7ff}\x{f900}-\x{faff}]{12}")

OP10 = rf"""
with texts as (select row_number() over () as row_id, doc_id, coalesce(text, '') as t
  from documents),
words as (select row_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') as w
  from texts),
placed as (select row_id, w[i] as word, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram
  from (select row_id, w, unnest(range(1, len(w) + 1)) as i from words)),
twice as (select row_id, i from (
  select row_id, i, count(*) over (partition by row_id, gram) as n from placed
  where gram is not null) where n > 1),
covered as (select row_id, count(distinct i + d) as n_repeat_words
  from twice cross join (values (0), (1), (2)) as s(d) group by row_id),
lines as (select row_id, k, l[k] as line, lower(l[k]) as low,
    regexp_matches(l[k], '[^ \t\n\x0b\f\r]') as filled
  from (select row_id, l, unnest(range(1, len(l) + 1)) as k
  from (select row_id, string_split(t, chr(10)) as l from texts))),
furnished as (select *, length(low) - length(regexp_replace(low, '{_PHRASES}', '', 'g')) as furniture
  from lines),
kinds as (select *, case
    when regexp_matches(line, '[|][^|]*[|][^|]*[|]')
      or length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > 0.1 * length(line)
      or (regexp_matches(line, '!!{_SPACE}*{_END}') and line = upper(line))
      or (furniture > 0 and 8 * furniture >= length(low))
      or (furniture > 0 and 20 * furniture >= length(low) and regexp_matches(low,
        '(^|[.!?|…] *|^ +){_PHRASES} *([.!?|…]|{_END})')) then 0
    when regexp_matches(line, '{_SENTENCE}') then 2
    when regexp_matches(line, '{_SEVERAL}') then 1 else 0 end as kind
  from furnished),
judged as (select *, kind = 0 or coalesce(min(case when kind <> 1 then 4 * k + kind end) over (
    partition by row_id order by k rows between current row and unbounded following), 0) % 4 <> 2 as fails
  from kinds),
by_line as (select row_id, count(*) filter (where filled) - count(distinct line) filter (where filled) as n_dup_lines,
    greatest(coalesce(sum(length(line) + 1) filter (where filled), 0) - 1, 0) as chars,
    greatest(coalesce(sum(length(line) + 1) filter (where not fails), 0) - 1, 0) as good_chars
  from judged group by row_id),
counted as (
  select x.doc_id, len(w.w) as n_words, length(array_to_string(w.w, '')) as word_chars,
    length(x.t) - length(regexp_replace(x.t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(b.n_dup_lines, 0) as n_dup_lines, coalesce(c.n_repeat_words, 0) as n_repeat_words,
    coalesce(b.chars, 0) as chars, coalesce(b.good_chars, 0) as good_chars
  from texts x join words w on x.row_id = w.row_id left join by_line b on x.row_id = b.row_id
  left join covered c on x.row_id = c.row_id)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and chars - good_chars <= 0.5 * chars
    as kept
from counted
"""

OP5 = """
with records as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
    sha1(encode(coalesce(html, ''))) as payload_digest from pages),
heads as (select payload_digest, max(page_id) as head from records where payload_bytes >= 1000
  group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when h.head is not null and (page_id is null or page_id < h.head) then 'revisit'
    else 'response' end as record_type,
  case when h.head is not null and (page_id is null or page_id < h.head) then h.head end
    as refers_to
from records left join heads h using (payload_digest)
"""

# Character ranges of the words: after lower-casing, all but the ASCII that is no letter or digit.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
with texts as (select row_number() over () as row_id, doc_id, {_WORDS} as w from documents),
items as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
windows as (select distinct item, least(13, len(w)) as n,
    array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as gram
  from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items
    where len(w) > 0)),
sizes as (select distinct n from windows),
grams as (select row_id, i, n, array_to_string(w[i:i + n - 1], ' ') as gram
  from (select row_id, w, n, unnest(range(1, len(w) - n + 2)) as i from texts cross join sizes
    where len(w) >= n)),
found as (select g.row_id, g.i, g.n, x.item from grams g join windows x on g.gram = x.gram and g.n = x.n),
hit as (select row_id, count(distinct place) as n_hit
  from (select row_id, unnest(range(i, i + n)) as place from found) group by row_id),
named as (select row_id, list_sort(list(distinct item)) as items from found group by row_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  cast(coalesce(len(items), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from texts left join hit using (row_id) left join named using (row_id)
"""

# The CRC-32 of each distinct word, byte by byte over a table made here; then counts, gains, scores.
OP12 = f"""
with recursive crc_bits as (select i as byte, cast(i as bigint) as r, 0 as step from range(256) as t(i)
  union all select byte, case when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end, step + 1
  from crc_bits where step < 8),
crc_table as (select list(r order by byte) as steps from crc_bits where step = 8),
docs as (select row_number() over () as row_id, doc_id, {_WORDS} as w from documents),
doc_words as (select row_id, unnest(w) as word from docs),
target_words as (select unnest(w) as word from (select {_WORDS} as w from benchmark)),
spelled as (select word, hex(encode(word)) as h
  from (select word from doc_words union select word from target_words)),
coded as (select word, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(h), 2),
      lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda r, b: xor(r // 256, steps[xor(r % 256, b) + 1])), 4294967295) % 10000 as bucket
  from spelled cross join crc_table),
raw as (select bucket, count(*) as n from doc_words join coded using (word) group by bucket),
wanted as (select bucket, count(*) as n from target_words join coded using (word) group by bucket),
totals as (select (select coalesce(sum(n), 0) + 10000 from raw) as above,
  (select coalesce(sum(n), 0) + 10000 from wanted) as below),
gains as (select bucket, cast(floor(1000 * ln((cast(coalesce(wanted.n, 0) + 1 as double) * above)
    / (cast(raw.n + 1 as double) * below))) as bigint) as gain
  from raw left join wanted using (bucket) cross join totals),
weights as (select row_id, sum(gain) as weight
  from doc_words join coded using (word) join gains using (bucket) group by row_id),
noised as (select doc_id, cast(len(w) as bigint) as n_features,
    cast(coalesce(weight, 0) as bigint) as weight,
    ('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint as h
  from docs left join weights using (row_id)),
scored as (select doc_id, n_features, weight,
    weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score
  from noised),
ordered as (select *, row_number() over (partition by n_features >= 20
    order by score desc, doc_id nulls last, n_features, weight) as place,
  count(*) filter (where n_features >= 20) over () as n from scored)
select doc_id, n_features, weight, score,
  case when n_features >= 20 and place <= n // 10 then place end as rank
from ordered
"""


def _clustering(clusters: int, size: int, scale: int, rounds: int, seed: int) -> str:
    """Rounds of exact means written out, each as a step of its own."""
    steps = []
    for step in range(rounds + 1):
        steps.append(f"""a{step} as materialized (select row_id, arg_min(number, (d, number)) as number,
    min(d) as d from (select row_id, number, sum((v.x - c.x) * (v.x - c.x)) as d
    from parts v join c{step} c using (place) group by row_id, number) group by row_id)""")
        if step < rounds:
            steps.append(f"""m{step} as (select number, place, sum(x)::hugeint as s, count(*) as n
    from a{step} join parts using (row_id) group by number, place),
c{step + 1} as materialized (select c.number, c.place,
    coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) as x
    from c{step} c left join m{step} m using (number, place))""")
    return f"""
with kept as (select row_number() over () as row_id, vec_id,
    list_transform(embedding, lambda x: floor({scale} * x::double)::hugeint) as v
  from embeddings where len(embedding) = {size}
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}),
parts as materialized (select row_id, unnest(v) as x, unnest(range({size})) as place from kept),
firsts as (select row_id, row_number() over (
    order by sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as number
  from kept qualify number < {clusters}),
c0 as materialized (select number, place, x from firsts join parts using (row_id)),
{", ".join(steps)},
digests as (select number, sha256(string_agg(cast(x as varchar), ',' order by place)) as h
  from c{rounds} group by number)
select vec_id, cast(number as integer) as cluster, cast(d as bigint) as distance,
  cast(sum(d) over (partition by number) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, h as centroid_sha256
from a{rounds} join kept using (row_id) join digests using (number)
"""


OP11 = _clustering(clusters=8, size=64, scale=1024, rounds=10, seed=3)


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": OP11, "op12_importance_resampling": OP12, "op3_url_filter": OP3, "op5_warc": OP5, "op6_benchmark_decontamination": OP6,
            "op10_quality_rules": OP10}
