"""The registered queries over the operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.llm import (divergence, embeddings, exact, filter_audit, kneser_ney, langid, licenses, lines, mixing,
                         sentencepieces, simhash, toxicity, warc)
from tallyfs.llm.common import BROADCAST_ROWS, bounded_broadcast, documents, table
from tallyfs.session import scratch_path


def op1_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_dedup(spark, table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(spark, documents(spark, sf_dir)).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        "kept", "text_sha256")


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(spark, documents(spark, sf_dir)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return kneser_ney.quality(spark, documents(spark, sf_dir), trusted).drop("rk")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(spark, documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, whether they decode to its text, and how many
    chunks the text was scanned in."""
    coded = sentencepieces.encode(spark, documents(spark, sf_dir).select("doc_id", "text"), verify=True)
    around = sentencepieces.Pieces(sentencepieces.load_model()).longest
    chunks = F.expr(f"int(greatest(1, (coalesce(length(text), 0) + {sentencepieces.CHUNK - around}) div {sentencepieces.CHUNK}))")
    return coded.select("doc_id", F.size("token_ids").alias("n_tokens"), "round_trip", chunks.alias("n_chunks"), "token_ids")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, deleted lines and runs, and a hash of what is left."""
    rows = lines.line_dedup(spark, documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                       F.size("removed").cast("long").alias("n_removed"), F.col("n_runs").cast("long").alias("n_runs"),
                       F.array_join(F.expr("transform(removed, x -> cast(x as string))"), ",").alias("removed"),
                       F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document's place in the mix."""
    mixed, _ = mixing.mix(spark, documents(spark, sf_dir))
    return mixing.mixed_rows(mixed, ["doc_id", "source", "mix_tokens", "mix_place"])


def _remainder(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows outside the held-out fifth."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(_remainder(5) != 0)
    labels, _ = bounded_broadcast(labels, BROADCAST_ROWS)
    scored = toxicity.toxicity(spark, docs, docs.join(labels, "doc_id"))
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows outside the held-out quarter."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = langid.identify(spark, docs, docs.filter(_remainder(4) != 2))
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters, per language."""
    return filter_audit.audit(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language, and the terms that mark a source."""
    return divergence.divergence(spark, documents(spark, sf_dir))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives below the checkpoint folder and read back."""
    archives = warc.write_warc(spark, table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    records = warc.read_warc(spark, archives).filter("kind = 'record' and type in ('response', 'revisit')")
    return warc.resolve(records).select(
        F.col("key").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_key").alias("refers_to"))


QUERIES = {
    "op1_embedding": op1_embedding,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license": op3_license,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_lines": op7_lines,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_langid": op10_langid,
    "op11_filter_audit": op11_filter_audit,
    "op12_divergence": op12_divergence,
    "op13_warc": op13_warc,
}

ORACLE_SQL = {
    "op1_embedding": r"""
        with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings),
             g as (select * from v where label is not null and len(e) > 0
                   and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
                   and len(list_filter(e, lambda x: x <> 0)) > 0),
             l as (select a.vec_id a, b.vec_id b from g a join g b
                   on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
                   where list_cosine_similarity(a.e, b.e) >= 0.93),
             r as (select vec_id a, vec_id b from v union select r.a, l.b from r join l on r.b = l.a)
        select vec_id, (select count(*) from l where l.a = v.vec_id) as n_links,
               (select min(b) from r where r.a = v.vec_id) as component_id,
               vec_id = (select min(b) from r where r.a = v.vec_id) as kept
        from v""",
    "op2_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents),
             g as (select t, min(doc_id) keep_id, count(*) group_size from n group by t)
        select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
        from n join g using (t)""",
    "op3_license": r"""
        with t(label, base, notice, p1, at1, p2, at2) as (values
               ('cc-by', true, 'cc by', 'cc by', 0, null, 0),
               ('gpl', true, 'general public license', 'general public license', 0, null, 0),
               ('reserved', true, 'all rights reserved', 'all rights reserved', 0, null, 0),
               ('apache', false, 'licensed under the apache license version 2 0', 'apache license', 3, null, 0),
               ('mit', false, 'released under the mit license', 'mit license', 3, null, 0),
               ('mit', false, 'permission is hereby granted free of charge to any person obtaining a copy of this software',
                'permission is hereby granted', 0, 'free of charge', 4),
               ('bsd', false, 'redistribution and use in source and binary forms with or without modification are permitted',
                'redistribution and use in source and binary forms', 0, null, 0),
               ('cc-by-nc', false, 'licensed under cc by nc 4 0', 'cc by nc', 2, null, 0),
               ('cc-by-sa', false, 'licensed under cc by sa 4 0', 'cc by sa', 2, null, 0),
               ('cc0', false, 'cc0 1 0 universal public domain dedication', 'cc0 1 0', 0, null, 0),
               ('gnu-gpl', false, 'licensed under the gnu general public license version 3', 'gnu general public license', 3, null, 0),
               ('lgpl', false, 'gnu lesser general public license', 'lesser general public license', 1, null, 0),
               ('agpl', false, 'gnu affero general public license', 'affero general public license', 1, null, 0),
               ('mpl', false, 'mozilla public license version 2 0', 'mozilla public license', 0, null, 0),
               ('isc', false, 'permission to use copy modify and or distribute this software for any purpose',
                'permission to use copy modify and or distribute', 0, null, 0),
               ('unlicense', false, 'this is free and unencumbered software released into the public domain',
                'free and unencumbered software', 2, 'public domain', 8),
               ('warranty', false, 'the software is provided as is without warranty of any kind', 'without warranty of any kind', 6, null, 0)),
             w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from documents),
             tt as (select *, string_split(notice, ' ') nw, string_split(p1, ' ') w1, coalesce(string_split(p2, ' '), []) w2 from t),
             c as (select w.*, tt.*, unnest(range(len(words))) i from w join tt on list_contains(words, w1[1])),
             s as (select *, i - at1 as s0 from c where words[i + 1] = w1[1] and words[i + 1:i + len(w1)] = w1),
             f as (select doc_id, label, base, s0, len(list_filter(range(len(nw)), lambda k: s0 + k >= 0 and s0 + k < len(words)
                          and words[greatest(s0 + k, 0) + 1] = nw[k + 1])) / len(nw)::double as share
                   from s where p2 is null or (s0 + at2 >= 0 and words[greatest(s0 + at2, 0) + 1:s0 + at2 + len(w2)] = w2)),
             a as (select doc_id, count(*) filter (base) n_base, min(s0) filter (base) first_word, max(s0) filter (base) last_word,
                   string_agg(distinct label, ',' order by label) filter (base) base_labels,
                   string_agg(distinct label, ',' order by label) labels, max(share) score from f group by doc_id)
        select w.doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
        from w left join a using (doc_id)""",
    "op7_lines": r"""
        with x as (select doc_id, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no
                   from documents),
             l as (select *, trim(raw, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) line,
                   len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) w from x),
             k as (select *, row_number() over (partition by doc_id order by no) k, sum(w) over (partition by doc_id order by no) cum
                   from l where w > 0),
             d as (select doc_id, list(line order by k) ls from k group by doc_id),
             r as (select a.doc_id, a.k s, b.k e, array_to_string(d.ls[a.k:b.k], chr(10)) body
                   from k a join k b on a.doc_id = b.doc_id and b.k between a.k and a.k + 3 join d on d.doc_id = a.doc_id
                   where b.cum - a.cum + a.w >= 4 and (b.cum - b.w - a.cum + a.w < 4 or b.cum - a.cum < 4)),
             c as (select *, row_number() over (partition by body order by doc_id, s) copy from r),
             g as (select distinct c.doc_id, k.k, k.no from c join k on k.doc_id = c.doc_id and k.k between c.s and c.e where copy > 1),
             q as (select doc_id, count(*) n_removed, string_agg(no::varchar, ',' order by no) removed,
                   count(*) filter (not exists (select 1 from g h where h.doc_id = g.doc_id and h.k = g.k - 1)) n_runs
                   from g group by doc_id),
             z as (select l.doc_id, string_agg(raw, chr(10) order by l.no) clean from l left join g on g.doc_id = l.doc_id and g.no = l.no
                   where g.no is null group by l.doc_id)
        select documents.doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end as n_lines,
               coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs, coalesce(removed, '') as removed,
               sha256(coalesce(clean, '')) as clean_sha256
        from documents left join q on q.doc_id = documents.doc_id left join z on z.doc_id = documents.doc_id""",
    "op11_filter_audit": r"""
        with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') part from documents),
             firsts as (select t, min(doc_id) m from d group by t),
             lab as (select doc_id, bool_or(quality = 1) g, bool_or(toxic = 1) x from labels group by doc_id),
             w as (select d.*, m, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') ws, length(d.t) cp,
                   length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g')) up from d join firsts using (t)),
             f as (select doc_id, part, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
                   + 4 * (100 * up > 10 * cp)::int + 8 * regexp_matches(t, '[#$%&*|]')::int
                   + 16 * coalesce(doc_id > m, false)::int as mask from w),
             c as (select part, mask, coalesce(g, false) g, coalesce(x, false) x, count(*) n
                   from f left join lab using (doc_id) group by all),
             k(i) as (values (0), (1), (2), (3), (4)),
             o as (select [a.i, b.i, c.i, d.i, e.i] p from k a, k b, k c, k d, k e
                   where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
             s as (select array_to_string(list_transform(p, lambda z: substr('ABCDE', z + 1, 1)), '') filter_order, j as step,
                   1 << p[j] as bit, coalesce(list_sum(list_transform(p[1:j - 1], lambda z: 1 << z)), 0)::int as earlier
                   from o, (select unnest(range(1, 6)) j)),
             r as (select part, filter_order, step, bit,
                   coalesce(sum(n) filter (mask & (earlier | bit) = 0), 0) kept,
                   coalesce(sum(n) filter (mask & earlier = 0 and mask & bit <> 0), 0) removed,
                   coalesce(sum(n) filter (mask & earlier <> 0 and mask & bit <> 0), 0) redundant,
                   coalesce(sum(n) filter (mask = bit), 0) unique_fails,
                   coalesce(sum(n) filter (g and mask & earlier = 0 and mask & bit <> 0), 0) good_lost,
                   coalesce(sum(n) filter (x and mask & earlier = 0 and mask & bit <> 0), 0) toxic_lost
                   from c, s group by all)
        select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
               redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
               toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
        from r""",
    "op12_divergence": r"""
        with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
             x as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
             kept as (select lang, term from x group by 1, 2 having count(distinct rid) >= 10),
             c as (select lang, source, term, count(*) n from x semi join kept using (lang, term) group by all),
             v as (select lang, count(*) v from kept group by 1),
             g as (select lang, source, coalesce(v, 0) v, coalesce((select sum(n) from c where c.lang = s.lang and c.source = s.source), 0) n
                   from (select distinct lang, source from d) s left join v using (lang)),
             p as (select g.lang, g.source, term, coalesce(c.n, 0) n,
                   1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) p
                   from g join kept using (lang) left join c using (lang, source, term)),
             l as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // ((select sum(n) from c where c.lang = p.lang)
                   + 2 * (select v from v where v.lang = p.lang)) q from p group by lang, term),
             pv as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) f
                    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
             pairs as (select a.lang, a.source, b.source item, coalesce(f, 0)::bigint as value from g a join g b on a.lang = b.lang
                    and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
             terms as (select lang, source, term item, (((p - q) * (p - q)) // (p + q))::bigint as value
                       from p join l using (lang, term) where n > 0 and p > q),
             u as (select lang, source, 'pair' part, item, value from pairs union all select lang, source, 'term', item, value from terms),
             r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from u)
        select * from r where part = 'pair' or rank <= 10""",
    "op13_warc": r"""
        with p as (select page_id, encode(coalesce(html, '')) b from pages),
             h as (select page_id, octet_length(b)::bigint n, sha1(b) s, max(page_id) over (partition by b) m from p),
             v as (select *, list_transform(range(0, 8), lambda k: ('0x' || substr(s, 5 * k + 1, 5))::bigint) five,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' abc from h)
        select page_id, n as payload_bytes, array_to_string(list_transform(five, lambda x: substr(abc, (x >> 15) + 1, 1)
               || substr(abc, ((x >> 10) & 31) + 1, 1) || substr(abc, ((x >> 5) & 31) + 1, 1) || substr(abc, (x & 31) + 1, 1)), '')
               as payload_digest, case when page_id is not distinct from m then 'response' else 'revisit' end as record_type,
               case when page_id is distinct from m then m end as refers_to
        from v""",
}
