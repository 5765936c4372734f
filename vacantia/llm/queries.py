"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.durable import persist, settled
from vacantia.llm import ann, bpe, chat, codes, exact, jaccard, langid, lines, lm, mixing, repair, secrets, simhash
from vacantia.llm.common import remainder


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-parsing language of every document; ids whose crc32 is 0 modulo 5 are held out."""
    docs = table(spark, sf_dir, "documents")
    out = remainder(F.col("doc_id"), 5) == 0
    model = langid.fit(docs, ~out)
    return langid.predict(docs, model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest id it is linked to."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with a digest of the base kinds."""
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, secrets.KINDS[:3]),
        F.sha2(F.concat_ws(",", F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))), 256).alias("base_sha256"),
        F.concat_ws(",", shown).alias("spans"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the interpolated and the base model."""
    return lm.score(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one (-1) that is full of marks, formatted and read back; given rows of id -1 join that one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "'</s>[INST] ok [/INST]'"
    planted = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"{marks} as text")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.col("under")
    chats = chat.format_chats(turns.unionByName(planted)).withColumn("under", chat.under_mask(F.col("formatted"), F.col("loss")))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that keeps something, with a digest of what its text is without the lines that go."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", (F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_left"), "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of weights 3, 1, 2 and one and a half times the words takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and a digest of what they make of every conversation, after damage."""
    return repair.report(repair.damaged(table(spark, sf_dir, "conversations")), F.col("present"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of shingles and the smallest id it is linked to."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error of its label, and a digest of the codebooks."""
    rows, books = codes.compress(table(spark, sf_dir, "embeddings"))
    coded = persist(rows.select("vec_id", "label", F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error"))
    sums = persist(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def written(query):
    """The query's result as a table; what its operator has written on the way is deleted."""
    return functools.wraps(query)(lambda spark, sf_dir: settled(lambda: query(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, written(op2_simhash), written(op3_exact_dedup), op4_secrets, op5_bpe, written(op6_lm_score), op7_chat_format, written(op8_line_dedup), written(op9_nearest), written(op10_mixing),
        op11_conversation_repair, written(op12_jaccard_join), written(op13_vector_codes),
    )
}

def vector_codes_sql() -> str:
    """Assignment and mean, round after round, and the last assignment."""
    steps = []

    def near(out: str, book: str) -> None:
        steps.append(f"""{out} as materialized (
            select row, vec_id, label, part, x, arg_min(word, (d, word)) as word, min(d) as d from (
                select p.*, b.word, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from p join {book} as b using (part)
            ) group by row, vec_id, label, part, x
        )""")

    for k in range(codes.ROUNDS):
        near(f"a{k}", f"b{k}")
        steps.append(f"""b{k + 1} as materialized (
            select b.part, b.word, case when m.x is null then b.x else m.x end as x from b{k} as b left join (
                select part, word, list(v order by pos) as x from (
                    select part, word, pos, ((sum(x[pos]) - ((sum(x[pos]) % count(*)) + count(*)) % count(*)) // count(*))::bigint as v from a{k}, places group by part, word, pos
                ) group by part, word
            ) as m using (part, word)
        )""")
    near("last", f"b{codes.ROUNDS}")
    return f"""
        with v as (
            select row_number() over () as row, vec_id, label, list_transform(embedding, lambda x: floor(x::double * {codes.SCALE})::bigint) as vec from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0
        ), p as materialized (
            select row, vec_id, label, vec, part, vec[1 + part * (len(vec) // {codes.PARTS}) : (part + 1) * (len(vec) // {codes.PARTS})] as x from v, range({codes.PARTS}) as r(part)
        ), places as materialized (
            select pos from range(1, 1 + (select max(len(x)) from p)) as r(pos)
        ), b0 as materialized (
            select part, (row_number() over (partition by part order by vec_id nulls last, vec)) - 1 as word, x from p qualify word < {codes.WORDS}
        ), {", ".join(steps)},
        e as (
            select row, vec_id, label, string_agg(printf('%02x', word), '' order by part) as code, sum(d)::bigint as error from last group by row, vec_id, label
        )
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
            (select sha256(string_agg(v::varchar, ',' order by part, word, pos)) from (select part, word, pos, x[pos] as v from b{codes.ROUNDS}, places)) as codebooks_sha256
        from e
    """


ORACLE_SQL = {
    "op3_exact_dedup": """
        with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, h as text_sha256
        from d window g as (partition by h)
    """,
    "op7_chat_format": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e as (
            select *, length(role) + length(text) + 9 + case
                when regexp_matches(role || chr(10) || text, '</?s>|<~+(/s|s|n)>') or contains(role, chr(10))
                then length(regexp_replace(text, '<(~*)(/s|s|n)>', '<~\1\2>', 'g')) - length(text) + length(regexp_replace(role, '<(~*)(/s|s|n)>', '<~\1\2>', 'g')) - length(role) else 0 end as size
            from t
        )
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            sum(size)::bigint as formatted_chars
        from e group by conv_id
    """,
    "op11_conversation_repair": r"""
        with recursive h as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                xor(list_reduce(
                    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint),
                    lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end), xor(a, b)), 4294967295::bigint
                ), 4294967295) % 20 as what
            from conversations
        ), d as (
            select conv_id, turn, case what when 4 then 'user' else role end as role, case what when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                unnest(range(case what when 3 then 2 else 1 end)) as copy from h where what <> 0
        ), o as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, text, seen) as i, case when role = '' then ' ' else role[1] end as initial
            from (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as seen from d)
        ), f as materialized (
            select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when seen > 1 then 2 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault,
                lag(initial) over (partition by conv_id order by i) as last from o
        ), dp as (
            select distinct conv_id, 0::bigint as i, '' as state, {'cost': 0, 'audit': '', 'said': ''} as best from f
            union all
            select conv_id, i + 1, to_state, min({'cost': cost, 'audit': audit, 'said': said}) from (
                select dp.conv_id, dp.i, case e when 'D' then mid when 'K' then initial else case mid when 'u' then 'a' else 'u' end end as to_state,
                    best.cost + 5 * k + case e when 'D' then 2 when 'K' then 0 else 1 end + case when fault = 3 and e <> 'D' then 5 else 0 end as cost,
                    best.audit || case k when 1 then 'I' else '' end || e as audit,
                    best.said || case k when 1 then chr(10) || case mid when 'u' then 'user:' else 'assistant:' end else '' end
                        || case e when 'D' then '' when 'K' then chr(10) || role || ':' || text else chr(10) || case mid when 'u' then 'assistant' else 'user' end || ':' || text end as said
                from (select *, case when k = 0 then state when state = 'u' then 'a' else 'u' end as mid from dp, (values (0), (1)) as inserted(k)) as dp
                join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1, (values ('D'), ('K'), ('R')) as edits(e)
                where (e = 'D' or fault in (0, 3)) and (e <> 'K' or mid || initial in ('s', 'u', 'su', 'ua', 'au'))
            ) group by conv_id, i, to_state
        ), ends as (
            select conv_id, min(case when state = 'u' then {'cost': best.cost + 5, 'audit': best.audit || 'I', 'said': best.said || chr(10) || 'assistant:'} else best end) as best
            from dp join (select conv_id as c, max(i) as n from f group by conv_id) as sizes on c is not distinct from conv_id and n = i where state <> 's' group by conv_id
        ), counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
                count(*) filter (fault = 3) as truncated, count(*) filter (last is not null and last || initial not in ('su', 'ua', 'au')) as illegal from f group by conv_id
        )
        select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
            coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(best.said[2:], '')) as repaired_sha256
        from (select distinct conv_id from conversations) as c left join ends on ends.conv_id is not distinct from c.conv_id left join counts on counts.conv_id is not distinct from c.conv_id
    """,
    "op12_jaccard_join": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
        ), s as materialized (
            select doc_id, list_distinct(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as tokens from w
        ), t as materialized (
            select doc_id, len(tokens) as n, unnest(tokens) as token from s
        ), links as materialized (
            select a.doc_id as a, b.doc_id as b from t as a join t as b on a.token = b.token and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach as (
            select doc_id, doc_id as other from s union select doc_id, b from reach join links on other = a
        )
        select doc_id, len(tokens)::bigint as n_shingles, component_id from s join (select doc_id, min(other) as component_id from reach group by doc_id) using (doc_id)
    """,
    "op13_vector_codes": vector_codes_sql(),
}
