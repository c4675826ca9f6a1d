"""The registered queries of this subpackage, each with the contract's columns; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP5 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (
  select doc_id, k, array_to_string(ws[k:k + 19], ' ') as s
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as k from w where len(ws) >= 20)
), later as (
  select doc_id, k from (select *, row_number() over (partition by s order by doc_id, k) as r from win) where r > 1
), gone as (select distinct doc_id, k + j as p from later, (select unnest(range(0, 20)) as j)),
words as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as p from w),
kept as (
  select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by 1
)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""


@query("op5_substring_dedup", OP5)
def op5(spark, sf_dir):
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), width=20, texts=False)


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    import public_tokenizers

    from .bpe import digests

    return digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN, keep=["doc_id"],
    )


OP10 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from documents
), sh as (
  select distinct doc_id, s from (
    select doc_id, array_to_string(ws[k:k + 3], ' ') as s
    from (select doc_id, ws, unnest(range(1, len(ws) - 2)) as k from w where len(ws) >= 4)
    union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 3)
), sizes as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)
), both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id as a, doc_id as b from w union select a, y from reach join both_ways on b = x)
select w.doc_id, coalesce(max(n), 0)::bigint as n_shingles, min(b) as component_id
from w join reach on w.doc_id = a left join sizes on sizes.doc_id = w.doc_id group by w.doc_id
"""


@query("op10_ngram_jaccard_join", OP10)
def op10(spark, sf_dir):
    from .jaccard import near_components

    return near_components(table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op1_document_fingerprints")
def op1(spark, sf_dir):
    from .fingerprints import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents"))


@query("op4_mix_sources")
def op4(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), [1, 2, 3]).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..session import stage
    from .preference import learned_from, score_of
    from .stats import SHARES, with_stats

    # texts are read once; nine numbers of each are written for the learning and the scores
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("__id"), "text")
    measured = stage(with_stats(docs, "text", ["__id"]).select("__id", *SHARES))
    return score_of(measured, learned_from(measured, table(spark, sf_dir, "labels")))


@query("op8_quality_rules")
def op8(spark, sf_dir):
    from .rules import judge, learned

    docs = table(spark, sf_dir, "documents")
    return judge(docs, learned(docs, table(spark, sf_dir, "labels")))


@query("op9_url_filter")
def op9(spark, sf_dir):
    from .urls import Rule, judge

    rules = [
        Rule("net", "/", True), Rule("example.net", "/en/", False), Rule("example.com", "/de/", True), Rule("org", "/fr/", False),
    ]
    return judge(table(spark, sf_dir, "pages"), rules).drop("score")


OP7 = r"""
with lines as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line from documents where text is not null
), trimmed as (
  select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as l from lines
), spread as (
  select l from trimmed where l <> '' group by l having count(distinct coalesce(source, chr(1))) >= 10
), split as (
  select doc_id, text, source, list_transform(string_split(text, chr(10)), lambda x:
    {'x': x, 'l': regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')}) as ls
  from documents
), kept as (
  select doc_id, text, ls, list_filter(ls, lambda z: z.l = '' or not list_contains(every, z.l)) as ks
  from split, (select coalesce(list(l), []) as every from spread)
), cut as (select *, len(list_filter(ks, lambda z: z.l <> '')) > 0 and len(ks) < len(ls) as is_cut from kept)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines,
  (case when is_cut then len(ls) - len(ks) else 0 end)::bigint as n_removed,
  sha256(coalesce(case when is_cut then array_to_string(list_transform(ks, lambda z: z.x), chr(10)) else text end, '')) as kept_sha256
from cut
"""


@query("op7_line_dedup", OP7)
def op7(spark, sf_dir):
    from pyspark.sql import functions as F

    from .lines import remove_spread

    out = remove_spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), counts=("n_lines", "n_removed"))
    return out.select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP2_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP2 = r"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
forms(rank, kind) as (values (0, 'assign'), (1, 'access'), (2, 'hex'), (3, 'entropy_hex'), (4, 'entropy_alnum'), (5, 'entropy_base64')),
cut as (
  select doc_id, rank, kind, m, list_transform(m, lambda x: length(x)) as ml, list_transform(g, lambda x: length(x)) as gl
  from (select doc_id, rank, kind,
      case rank when 0 then regexp_extract_all(t, '@assign') when 1 then regexp_extract_all(t, 'AKIA[A-Z0-9]+')
        when 2 then regexp_extract_all(t, '[0-9a-f]+') when 3 then regexp_extract_all(t, '[0-9a-fA-F]{20,}')
        when 4 then regexp_extract_all(t, '[0-9A-Za-z]{20,}') else regexp_extract_all(t, '[0-9A-Za-z+/_-]{20,}') end as m,
      case rank when 0 then string_split_regex(t, '@assign') when 1 then string_split_regex(t, 'AKIA[A-Z0-9]+')
        when 2 then string_split_regex(t, '[0-9a-f]+') when 3 then string_split_regex(t, '[0-9a-fA-F]{20,}')
        when 4 then string_split_regex(t, '[0-9A-Za-z]{20,}') else string_split_regex(t, '[0-9A-Za-z+/_-]{20,}') end as g
    from docs, forms where rank <> 2 or regexp_matches(t, '[0-9a-f]{32}'))
), found as (
  select doc_id, rank, kind, m[k] as v, (list_sum(gl[1:k]) + coalesce(list_sum(ml[1:k - 1]), 0))::bigint as s0, ml[k] as n
  from (select *, unnest(range(1, len(m) + 1)) as k from cut)
), base as (
  select doc_id, rank, kind, s0, s0 + n as stop from found
  where rank = 0 and length(regexp_extract(v, '@assign', 1)) >= 8 or rank = 1 and n >= 16 or rank = 2 and n >= 32
), mixed as (
  select doc_id, s0, s0 + n as stop, v, rank, kind,
    round(list_max(list_transform(range(1, length(v) - 18), lambda i: list_aggregate(string_split(substr(v, i, 20), ''), 'entropy'))), 9) as bits
  from found where rank > 2 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
    and not (rank = 4 and regexp_full_match(v, '[0-9a-fA-F]+')) and not (rank = 5 and regexp_full_match(v, '[0-9A-Za-z]+'))
    and not regexp_matches(v, '(?i)(example|sample|placeholder|changeme|dummy|xxxx|redacted)')
    and not regexp_matches(v, '(?i)0123456789|abcdefgh|12345678901234567890')
    and not regexp_matches(v, '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$')
), every as (
  select doc_id, rank, kind, s0, stop from base
  union all
  select doc_id, rank, kind, s0, stop from mixed where bits >= [2.9, 3.4, 3.8][rank - 2]
)
select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  sha256(coalesce(string_agg(kind || ':' || s0 || ':' || stop, ',' order by s0, rank) filter (rank < 3), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || s0 || ':' || stop, ',' order by s0, rank), '') as spans
from docs d left join every e on d.doc_id = e.doc_id group by d.doc_id
""".replace("@assign", OP2_ASSIGN)


@query("op2_secret_scan", OP2)
def op2(spark, sf_dir):
    from .secrets import digests

    return digests(table(spark, sf_dir, "documents"))


def _op11(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """The rounds written out, one set of common table expressions each."""
    distance = "list_sum(list_transform(range(1, len(x.p) + 1), lambda i: (x.p[i] - b.p[i]) * (x.p[i] - b.p[i])))"
    sql = f"""
with v as (
  select vec_id, label, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), x as (
  select vec_id, label, j::int as part, v[j * len(v) // {parts} + 1:(j + 1) * len(v) // {parts}] as p
  from v, (select unnest(range(0, {parts})) as j)
), b0 as (
  select part, (row_number() over (partition by part order by vec_id) - 1)::int as entry, p from x
  qualify row_number() over (partition by part order by vec_id) <= {entries}
)"""
    for r in range(rounds + 1):
        sql += f""", a{r} as (
  select vec_id, label, part, p, arg_min({{'entry': entry, 'd': d}}, {{'d': d, 'entry': entry}}) as n
  from (select x.*, b.entry, {distance} as d from x join b{r} b on x.part = b.part) group by 1, 2, 3, 4
)"""
        if r < rounds:
            sql += f""", m{r} as (
  select part, entry, list((s - ((s % c) + c) % c) // c order by i) as p
  from (select part, (n).entry as entry, i, sum(p[i])::bigint as s, count(*) as c from (select *, unnest(range(1, len(p) + 1)) as i from a{r}) group by 1, 2, 3)
  group by 1, 2
), b{r + 1} as (select b.part, b.entry, coalesce(m.p, b.p) as p from b{r} b left join m{r} m using (part, entry))"""
    return sql + f""", codes as (
  select vec_id, label, string_agg(lpad(lower(to_hex((n).entry)), 2, '0'), '' order by part) as code, sum((n).d)::bigint as error
  from a{rounds} group by 1, 2
), said as (
  select sha256(string_agg(c, ',' order by part, entry, i)) as s
  from (select part, entry, unnest(range(1, len(p) + 1)) as i, unnest(p)::varchar as c from b{rounds})
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, s as codebooks_sha256 from codes, said
"""


@query("op11_vector_codes", _op11())
def op11(spark, sf_dir):
    from .codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


OP12 = r"""
with recursive tab as (
  select list(list_reduce(list_concat([i], range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select unnest(range(0, 256)) as i)
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{C0}-\x{FF}]+')) as w from documents
), each as (select doc_id, w, count(*) as k from runs group by 1, 2),
bytes as (
  select *, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c:
    case when ord(c) < 128 then [ord(c)::bigint] else [192 | (ord(c)::bigint >> 6), 128 | (ord(c)::bigint & 63)] end)) as bs from each
), hashed as (
  select w, k, xor(4294967295, list_reduce(list_concat([4294967295], bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h from bytes, tab
), garbled as (
  select case when h % 97 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, k from hashed
), words as (
  select word, sum(k)::bigint as n from garbled where length(word) >= 5 group by 1 having sum(k) >= 3
), less as (select word, n, p, left(word, p - 1) || substr(word, p + 1) as s from (select *, unnest(range(1, length(word) + 1)) as p from words)),
near as (
  select distinct a.word, b.word as near, b.n from less a join less b on a.p = b.p and a.s = b.s and a.word <> b.word and length(a.word) = length(b.word)
  union select distinct a.word, b.word, b.n from less a join words b on a.s = b.word
  union select distinct b.word, a.word, a.n from less a join words b on a.s = b.word
), best as (select word, count(*) as n_near, arg_min({'near': near, 'n': n}, {'m': -n, 'near': near}) as f from near group by 1),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when (f).n >= 2 * w.n then (f).near end as form, case when (f).n >= 2 * w.n then (f).n end as form_n
  from words w left join best using (word)
), walk as (
  select word, word as here, 0 as steps from forms
  union all select walk.word, form, steps + 1 from walk join forms on forms.word = walk.here where form is not null
)
select word, form, root, n, n_near::bigint as n_near, form_n from forms join (select word, arg_max(here, steps) as root from walk group by 1) using (word)
"""


@query("op12_spelling_variants", OP12)
def op12(spark, sf_dir):
    from .spelling import corpus_words, variants

    return variants(corpus_words(table(spark, sf_dir, "documents")))


@query("op13_best_fit_packing")
def op13(spark, sf_dir):
    import public_tokenizers

    from .packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
