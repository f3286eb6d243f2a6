"""One query per operator over its whole table, and the SQL that must return the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, divergence, idcodec, linededup, minhash, mixing, quality, simhash, tokencount, toxicity, urlfilter, whitening
from .common import LOWER, UPPER, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations in chat form."""
    return chat.render(read(spark, sf_dir, "conversations"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return tokencount.token_counts(docs, tokencount.public_costs).drop("text")


@query
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of coded token ids hold of every document."""
    return idcodec.digest(idcodec.round_trip(read(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urlfilter.judge(read(spark, sf_dir, "pages", "page_id", "url")).drop("url")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("text", "source", "passes")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated runs of lines."""
    return linededup.dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs, benchmark = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark")
    return decontam.judge(docs, benchmark).drop("text", "n_near")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.judge(docs, labels).drop("text")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.judge(docs, labels.where("quality = 1").select("doc_id")).drop("text", "llr")


@query
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under shingle-set similarity."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the sources of each language, and their own terms."""
    return divergence.audit(read(spark, sf_dir, "documents", "lang", "source", "text"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


ORACLES["op1_chat"] = f"""
with rows as (
  select distinct conv_id, case when conv_id is null then 'r' || coalesce(role, '') || chr(1) || coalesce(text, '') else 'c' || conv_id end as conv,
         coalesce(case when conv_id is null then null else turn end, -9e17::bigint) as turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations),
units as (select conv, any_value(conv_id) as conv_id, turn, list({{'role': role, 'text': text}} order by role, text) as unit from rows group by conv, turn),
convs as (select conv, any_value(conv_id) as conv_id, list(unit order by turn) as units from units group by conv),
firsts as (select units, min({{'none': conv_id is null, 'conv_id': conv_id, 'conv': conv}}) as f from convs group by units),
prefixes as (select distinct units[1:k] as units from (select units, unnest(range(1, len(units))) as k from convs)),
kept as (select f.conv as conv, len(units) as n_turns from firsts where not exists (select 1 from prefixes p where p.units = firsts.units)),
placed as (select r.*, k.n_turns, (dense_rank() over (partition by r.conv order by r.turn) - 1) // {chat.BLOCK} as part
           from rows r join kept k using (conv))
select any_value(conv_id) as conv_id, part, any_value(n_turns) as n_turns,
       string_agg('{chat.BEGIN}' || role || chr(10) || text || '{chat.END}' || chr(10), '' order by turn, role, text) as text
from placed group by conv, part
"""


def _url_oracle() -> str:
    def low(x: str) -> str:
        return f"translate({x}, '{UPPER}', '{LOWER}')"

    def found(term: str) -> str:
        return f"regexp_matches(low_url, '(^|[^a-z0-9]){term}($|[^a-z0-9])')::int"

    def count(kind: str) -> str:
        return " + ".join(found(t) for t, k in urlfilter.VOCABULARY.items() if k == kind)

    rules = sorted(urlfilter.RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [(f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = " ".join(f"when {w} then '{r}'" for w, r, _ in fits)
    verdict = " ".join(f"when {w} then '{v}'" for w, _, v in fits)
    return f"""
with tails as (select page_id, coalesce({low('url')}, '') as low_url,
                      case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as tail from pages),
parts as (select page_id, low_url, {low("regexp_extract(tail, '^[^/?#]*')")} as host,
                 regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path from tails),
counted as (select *, {count('strict')} as n_strict, {count('soft')} as n_soft from parts)
select page_id, host, path, case {rule} end as rule,
       case {verdict} when n_strict > 0 or n_soft >= {urlfilter.SOFT_HITS} then 'block' else 'allow' end as verdict, n_strict, n_soft
from counted
"""


ORACLES["op5_url_filter"] = _url_oracle()


def _rounds(n: int) -> str:
    """Targets by resharing, written as rounds: sources found above their bound are held there."""
    steps = ["select source, source_size, w, false as held from weighed"]
    sql = f"r0 as ({steps[0]})"
    for k in range(1, n + 1):
        sql += f""",
r{k} as (select source, source_size, w, held or w * level > {mixing.MOST_PASSES} * source_size as held from r{k - 1},
      (select (max(total) - coalesce(sum(source_size) filter (held), 0) * {mixing.MOST_PASSES})::double
              / sum(w) filter (not held) as level from r{k - 1}, whole))"""
    return sql


ORACLES["op6_mixing"] = f"""
with sized as (select doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as n, text,
       len(text)::double as chars, len(regexp_extract_all(text, '[{mixing.SYMBOLS}]')) as symbols from documents),
keyed as (select doc_id, source, coalesce(n, 0)::bigint as size,
       greatest({mixing.LEAST_WEIGHT}, coalesce(case when chars > 0 then 1.0::double - 4.0::double * (symbols / chars) end, {mixing.LEAST_WEIGHT})) as weight,
       (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint + 0.5::double) / {1 << 48}.0::double as u from sized),
sources as (select source, sum(size)::bigint as source_size from keyed group by source),
whole as (select sum(source_size) as total from sources),
weighed as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from sources),
{_rounds(24)},
level as (select (max(total) - coalesce(sum(source_size) filter (held), 0) * {mixing.MOST_PASSES})::double / sum(w) filter (not held) as level from r24, whole),
plan as (select source, source_size, case when held then ({mixing.MOST_PASSES} * source_size)::double else level * w end as target from r24, level),
passes as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as full_passes from plan),
run as (select k.*, p.source_size, p.target, p.full_passes, p.target - p.full_passes * p.source_size as rest,
        sum(k.size) over (partition by k.source order by -ln(u) / weight, len(doc_id::varchar), doc_id::varchar rows unbounded preceding) as upto
        from keyed k join passes p on k.source is not distinct from p.source)
select doc_id, size, source_size::bigint as source_size, target,
       (size * (full_passes + case when upto <= rest or upto - rest < rest - (upto - size) then 1 else 0 end))::bigint as taken
from run
"""

ORACLES["op7_line_dedup"] = f"""
with lines as (select doc_id, unnest(range(len(l))) as i, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)),
hashed as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words from lines),
ended as (select *, lead(i) over w is null or words > {linededup.LONG_LINE} or lead(words) over w > {linededup.LONG_LINE}
          or h % {linededup.DIVISOR} = 0 as ends from hashed window w as (partition by doc_id order by i)),
cut as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as c from ended),
chunks as (select doc_id, c, min(i) as start, count(*) as n, string_agg(line, chr(10) order by i) as chunk,
           sum((words > 0)::int) >= {linededup.LEAST_LINES} and sum(words) >= {linededup.LEAST_WORDS} or sum(words) > {linededup.LONG_LINE} as large
           from cut group by doc_id, c),
marked as (select *, large and row_number() over (partition by chunk, large order by doc_id, start) > 1 as gone from chunks),
joined as (select doc_id, sum(n)::bigint as n_lines, sum(case when gone then n else 0 end)::bigint as n_removed,
           coalesce(string_agg(chunk, chr(10) order by start) filter (not gone), '') as text from marked group by doc_id)
select d.doc_id, case when d.text is not null then j.text end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed
from documents d left join joined j using (doc_id)
"""

ORACLES["op8_decontamination"] = f"""
with texts as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
wins as (select distinct item, n, array_to_string(w[s:s + n - 1], ' ') as run from (
   select item, w, least(len(w), {decontam.WINDOW}) as n, unnest(range(1, greatest(len(w) - {decontam.WINDOW - 1}, 1) + 1)) as s from items where len(w) > 0)),
sizes as (select distinct n from wins),
runs as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as run from (
   select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from texts, sizes where len(w) >= n)),
hits as (select r.doc_id, r.s, r.n, w.item from runs r join wins w using (n, run)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from hits)) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select t.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and {decontam.SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from texts t left join places using (doc_id) left join found using (doc_id)
"""

ORACLES["op12_source_divergence"] = f"""
with texts as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
               regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
occurrences as (select d, lang, source, unnest(w) as term from texts),
kept as (select lang, term from (select distinct lang, term, d from occurrences) group by lang, term having count(*) >= {divergence.LEAST_DOCUMENTS}),
sources as (select distinct lang, source from texts),
counts as (select lang, source, term, count(*) as n from occurrences join kept using (lang, term) group by all),
vocabulary as (select s.lang, count(term) as v from (select distinct lang from sources) s left join kept k on k.lang = s.lang group by s.lang),
columns as (select s.lang, s.source, k.term, coalesce(n, 0) as n from sources s join kept k on k.lang = s.lang
            left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
shares as (select *, 1 + {divergence.UNIT}::hugeint * (n + {divergence.SMOOTHING})
           // (sum(n) over (partition by lang, source) + {divergence.SMOOTHING} * v)::hugeint as p from columns join vocabulary using (lang)),
langs as (select lang, term, 1 + {divergence.UNIT}::hugeint * (sum(n) + {divergence.SMOOTHING})
          // (sum(sum(n)) over (partition by lang) + {divergence.SMOOTHING} * any_value(v))::hugeint as q from shares group by lang, term),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from sources a
          join sources b on a.lang = b.lang and a.source <> b.source
          left join (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
                     from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
          on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from shares join langs using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {divergence.TOP}
"""
