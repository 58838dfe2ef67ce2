"""The queries opN_<name>: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
import public_tokenizers
from pyspark.sql import functions as F

from vigil.llm import (
    ann_srs, chunk_bpe, collocations, jaccard_trie, line_dedup, line_quality, packing, pii_boost, prefix_trie, shard_mix, simhash_mih, toxicity, url_reputation,
)
from vigil.llm._common import table

SHARDS = 40
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and outcome of every page: its url ends in the number of the document it shows.

    bad: the document has a label of low quality or toxicity; null for pages without a label.
    """
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(url_reputation.url_parts(F.col("url"))[1], r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    pages = table(spark, sf_dir, "pages").select(
        url_reputation.url_parts(F.col("url"))[0].alias("host"), number.try_cast("bigint").alias("doc_id")
    )
    return pages.join(labels, "doc_id", "left").select("host", "bad")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_reputation.filter_urls(
        table(spark, sf_dir, "pages").select("page_id", "url"), page_outcomes(spark, sf_dir), rules=URL_RULES
    )
    return out.select("page_id", "host", "path", "rule", "verdict", "labelled", F.round("bad_low", 6).alias("bad_low"))


def op3_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_bpe.encode_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), outputs="digests")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_quality.judge_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_removed_lines", "n_left_words",
    )


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_srs.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.apply(line_dedup.build(docs), docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: shard sizes at most one row apart, each with the corpus's mixture of sources."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    return shard_mix.proportional_shards(docs, shards=SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_boost.find_spans(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col("row")["doc_id"].alias("doc_id"),
        *map(count, pii_boost.KINDS),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_mih.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "swap_gap"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    members = turns.select("conv_id").distinct()
    return prefix_trie.build(prefix_trie.rebuilt(turns), members).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_bpe_coding": op3_bpe_coding,
    "op4_quality_rules": op4_quality_rules,
    "op5_nearest": op5_nearest,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_WORD = r"[^\x20\x09-\x0D]+"
_LINES = "select doc_id, source, text, unnest(string_split(coalesce(text,''), chr(10))) line, unnest(range(len(string_split(coalesce(text,''), chr(10))))) i from documents"


def _level(n: str, k: str, parent: str, groups: str) -> str:
    """Prior strength by parent (ANOVA estimate of the intra-class correlation), as SQL."""
    return f"""(select {parent}, sum({n}) bn, sum({k}) bk, sum(case when {n}>0 then {k}*{k}/{n} end) kk, sum({n}*{n}) nn, sum(case when {n}>0 then 1 else 0 end) g from {groups} group by all)"""


def _strength(sums: str, parent: str) -> str:
    return f"""(select {parent}, bn, bk, 1/least(greatest(coalesce((b-w)/nullif(b+(n0-1)*w,0), 1/2001e0), 1/2001e0), 1/3e0)-1 strength from
(select *, (kk-bk*bk/nullif(bn,0))/nullif(g-1,0) b, (bk-kk)/nullif(bn-g,0) w, (bn-nn/nullif(bn,0))/nullif(g-1,0) n0 from {sums}))"""


_RULE = " ".join(
    f"when (host='{own}' or suffix(host, '.{own}')) and starts_with(path, '/{tail}') then '{what}|{own}/{tail}'"
    for what, (own, _, tail) in sorted(((v, r.partition("/")) for v, r in URL_RULES), key=lambda x: -len("".join(x[1])))
)

_SUFFIX3, _SUFFIX2 = ("[" + ",".join(f"'{x}'" for x in url_reputation.SUFFIXES if x.count(".") == n) + "]" for n in (2, 1))
_LAST = lambda n: f"array_to_string(list_slice(ls,-{n},-1),'.')"

ORACLES: dict[str, str] = {
    "op2_url_filter": f"""
with u as (select page_id, url, case when contains(url,'://') then substr(url, instr(url,'://')+3) end rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest,'^[^/?#]*'),'{_A}','{_Z}'),'') host,
 coalesce(regexp_extract(substr(rest, length(regexp_extract(rest,'^[^/?#]*'))+1), '^[^?#]*'),'') path from u),
o as (select host, bad::int bad from h left join (select doc_id, bool_or(quality=0 or toxic=1) bad from labels group by 1) l on l.doc_id = try_cast(nullif(regexp_extract(path,'/([0-9]{{1,18}})(?:\\.html)?/?$',1),'') as bigint)),
hs as (select *, regexp_replace(host,'^.*@|:[0-9]*$','','g') bare, string_split(regexp_replace(host,'^.*@|:[0-9]*$','','g'),'.') ls from o),
hosts as (select host, case when regexp_full_match(bare,'[0-9]+(\\.[0-9]+){{3}}') then bare when list_contains({_SUFFIX3},{_LAST(3)}) then {_LAST(3)} when list_contains({_SUFFIX2},{_LAST(2)}) then {_LAST(2)} else {_LAST(1)} end sfx,
 case when regexp_full_match(bare,'[0-9]+(\\.[0-9]+){{3}}') then bare when list_contains({_SUFFIX3},{_LAST(3)}) then {_LAST(4)} when list_contains({_SUFFIX2},{_LAST(2)}) then {_LAST(3)} else {_LAST(2)} end dom, count(bad)::double n, coalesce(sum(bad),0)::double k from hs where host<>'' group by all),
doms as (select sfx, dom, sum(n) n, sum(k) k from hosts group by all), sfxs as (select sfx, sum(n) n, sum(k) k from doms group by all),
c as (select strength s0, (coalesce(bk,0)+20e0*0.05e0)/(coalesce(bn,0)+20e0) m0 from {_strength(_level("n", "k", "1 one", "sfxs"), "one")}),
l1 as (select sfx, (k+s0*m0)/(n+s0) m1 from sfxs, c),
l2 as (select d.dom, (k+s.strength*m1)/(n+s.strength) m2 from doms d join l1 using(sfx) join {_strength(_level("n", "k", "sfx", "doms"), "sfx")} s using(sfx)),
ab as (select host, n, k+s.strength*m2 a, n-k+s.strength*(1-m2) b from hosts join l2 using(dom) join {_strength(_level("n", "k", "dom", "hosts"), "dom")} s using(dom)),
r as (select host, n::bigint labelled, greatest(0, a/(a+b)-1.645e0*sqrt(a*b/((a+b)*(a+b)*(a+b+1)))) bad_low from ab),
v as (select h.*, case {_RULE} end rv from h)
select page_id, host, path, string_split(rv,'|')[2] as rule, coalesce(string_split(rv,'|')[1], case when coalesce(bad_low,0)>0.3 then 'block' else 'allow' end) verdict,
coalesce(labelled,0) labelled, round(bad_low,6) bad_low from v left join r using(host)""",
    "op4_quality_rules": f"""
with d as (select doc_id, source, coalesce(text,'') text, regexp_extract_all(coalesce(text,''),'{_WORD}') ws from documents),
w as (select doc_id, unnest(ws) w, unnest(range(len(ws))) i from d),
win as (select doc_id, i, w||chr(32)||lead(w) over o||chr(32)||lead(w,2) over o x from w window o as (partition by doc_id order by i)),
rep as (select doc_id, i from (select *, count(*) over(partition by doc_id, x) c from win where x is not null) where c>1),
cov as (select doc_id, count(distinct p)::bigint n from (select doc_id, unnest([i,i+1,i+2]) p from rep) group by 1),
l as (select doc_id, source, text, line, i, len(regexp_extract_all(line,'{_WORD}')) nw, regexp_replace(translate(trim(line,{_BLANKS}),'{_A}','{_Z}'),'[0-9]+','0','g') k from ({_LINES})),
dup as (select doc_id, (count(line) - count(distinct line))::bigint n from l where nw>0 group by 1),
fr as (select source, k from l where nw>0 group by source, k having count(distinct coalesce(text,''))>20),
gone as (select l.doc_id, count(*) n, sum(nw)::bigint nw from l join fr on fr.source is not distinct from l.source and fr.k=l.k where nw>0 group by 1),
b as (select d.doc_id, len(ws)::bigint n_words, length(regexp_replace(d.text,'[\\x20\\x09-\\x0D]+','','g'))::bigint word_chars, length(regexp_replace(d.text,'[^#*$%&|<>]+','','g'))::bigint n_symbols,
 coalesce(dup.n,0) n_dup_lines, coalesce(cov.n,0) n_repeat_words, coalesce(gone.n,0) n_removed_lines, len(ws)-coalesce(gone.nw,0) n_left_words
 from d left join dup using(doc_id) left join cov using(doc_id) left join gone using(doc_id)),
f as (select *, n_words<50 or 100*n_repeat_words>50*n_words base_failed from b)
select *, not base_failed and n_left_words>=0.2*n_words kept from f""",
    "op6_line_dedup": f"""
with l as (select *, translate(trim(line,{_BLANKS}),'{_A}','{_Z}') x from ({_LINES})), k as (select *, case when length(x)>=40 then x end k from l),
c as (select k, count(distinct doc_id) n, max(doc_id) last from k where k is not null group by 1),
f as (select doc_id, i, line, coalesce(n>=5 and doc_id<>last, false) gone from k left join c using(k))
select doc_id, count(*) n_lines, count(*) filter(gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter(not gone),'')) kept_sha256 from f group by 1""",
    "op12_collocations": f"""
with p as (select coalesce(lang,'und') lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text,''),'{_A}','{_Z}'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') ws from documents),
g as (select lang, m, unnest(list_transform(range(1, len(ws)-m+2), lambda i: array_to_string(list_slice(ws, i, i+m-1), ' '))) phrase from p, range(1,6) s(m) where len(ws)>=m),
n as (select lang, sum(len(ws))::bigint n from p group by 1),
f as (select lang, m, phrase, string_split(phrase,' ') ws, count(*) f from g group by lang, m, phrase having count(*)>=100),
e as (select lang, unnest([array_to_string(list_slice(ws,1,m-1),' '), array_to_string(list_slice(ws,2,m),' ')]) phrase, f from f where m>2),
c as (select lang, m, phrase, ws, f a from f where m>1 and not exists (select 1 from e where e.lang=f.lang and e.phrase=f.phrase and 100*e.f>=100*f.f)),
k as (select *, unnest(range(1,m)) k from c),
s as (select k.lang, k.phrase, k.k, a, x.f l, y.f r, n, ((1000::hugeint*a*n) // (x.f::hugeint*y.f))::bigint score from k join n using(lang)
 join f x on x.lang=k.lang and x.phrase=array_to_string(list_slice(k.ws,1,k.k),' ') join f y on y.lang=k.lang and y.phrase=array_to_string(list_slice(k.ws,k.k+1,k.m),' ')),
b as (select * from s qualify row_number() over(partition by lang, phrase order by score, k)=1)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over(partition by lang order by score desc, a desc, phrase) rank from b) where rank<=2000""",
}
