"""The registered queries of the ten operators: thin wrappers that derive each contract's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import chat, langid, lm, merkle, neardup, neighbours, packing, personal, pieces, quality, runs, secrets, toxicity
from tallyhouse.llm.common import crc_mod, prepare, stored
from tallyhouse.sources.tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the documents that are not held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.learn_languages(docs.where(~held).select("text", "lang"))
    found = langid.identify_languages(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    prepare(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and context-mixing score of every document."""
    prepare(spark)
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    return lm.score_texts(table(spark, sf_dir, "documents"), ~held)


def tokenizer_file(name: str) -> str:
    """The installed vocabulary file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 4096 tokens."""
    prepare(spark)
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Token pieces of ``docs``, packed; the other capacities bind no sooner than the tokens do."""
    params = packing.PackParams()
    path = tokenizer_file("word_bpe_49k.json")
    cut = packing.token_pieces(docs, lambda: packing.shared_tokenizer(path), 1, params.tokens)
    return packing.pack(cut, params)


def op7_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's SentencePiece ids and of the text decoded from them."""
    prepare(spark)
    return pieces.piece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered: length and digest of each rendered text."""
    done = chat.format_conversations(table(spark, sf_dir, "conversations"))
    text = F.col("rendered")
    return done.select("conv_id", "n_turns", "n_same", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("sha256"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose vec_id is divisible by 20."""
    prepare(spark)
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of a learned decision list for every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = quality.learn_rules(quality.labelled_sample(docs, labels))
    judged = quality.apply_rules(quality.text_statistics(docs.select("doc_id", "text")), rules)
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the labels that are not held out."""
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    weight = toxicity.learn_toxicity(docs.select("doc_id", "text"), labels.where(~held).select("doc_id", "toxic"))
    scored = toxicity.toxicity_scores(docs.select("doc_id", held.alias("held_out"), "text"), weight)
    score = F.col("toxic_score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through a ledger that starts empty."""
    found = secrets.scan_ledger(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    of = lambda no: F.size(F.filter(spans, lambda s: s["no"] == no)).cast("long")
    base = secrets.span_text(F.filter(spans, lambda s: s["no"] < secrets.BASE_KINDS))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and the root that a leaf, tampered with for one in seven, leads to."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    digest = lambda n_chars: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    hit = F.coalesce(crc_mod(F.col("doc_id"), 7) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = stored(docs.select("doc_id", "lang", digest(F.col("n_chars")).alias("leaf"), F.when(hit, digest(F.col("n_chars") + 1)).alias("changed")))
    done = merkle.manifest(rows, F.col("lang"), ["doc_id"], "leaf")
    found = done.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal.find_personal(docs, personal.learn_field(docs))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda no: F.size(F.filter(base, lambda s: s["kind"] == no)).cast("long")
    counts = [of(no).alias(f"n_{kind}") for no, kind in enumerate(personal.KINDS)]
    return found.select("doc_id", *counts, F.sha2(personal.span_text(base), 256).alias("base_sha256"), personal.span_text(F.col("spans")).alias("spans"))


def repeated_words(text: Column, doc_id: Column) -> Column:
    """The text; for one id in ten, its words from some place on are periodic instead (null ids and texts stay)."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    found = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    draw = F.floor(crc / 10)
    start = lambda w: draw % F.size(w)
    period = lambda w: F.floor((F.size(w) - start(w)) / (draw % 8 + 3)) + 1

    def joined(s: Column) -> Column:
        place = lambda i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(s["w"]) - 1), lambda i: F.get(s["w"], place(i).cast("int"))), " ")

    # one-element arrays, so that the words and then the two numbers are computed once
    known = F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, F.struct(w.alias("w"), start(w).alias("a"), period(w).alias("p"))))
    return F.when((crc % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(known, joined), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, the longest one, and the text with one period of each."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_words(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs)
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * b.length div -b.p").alias("exponent_milli")
    return found.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"), milli, "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_context_mixing": op3_context_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_chat_format": op5_chat_format,
    "op6_quality_rules": op6_quality_rules,
    "op7_piece_codes": op7_piece_codes,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_personal_data": op12_personal_data,
    "op13_periodic_runs": op13_periodic_runs,
}



def _spans_of(no: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""select doc_id, {no} as no, '{rule.kind}' as kind, unnest(range(1, len(w) + 1)) as i, w, g, parts from (
        select doc_id, regexp_extract_all(t, '{pattern}', 0) as w, regexp_extract_all(t, '{pattern}', {rule.group}) as g, string_split_regex(t, '{pattern}') as parts from docs where regexp_matches(t, '{pattern}'))"""


def secret_scan_sql() -> str:
    """op9 in SQL: positions from the lengths of matches and of what lies between."""
    every = " union all ".join(_spans_of(no, r) for no, r in enumerate(secrets.RULES))
    least = "case no " + " ".join(f"when {no} then {r.least}" for no, r in enumerate(secrets.RULES)) + " end"
    total = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    text = "coalesce(string_agg(span, ',' order by start, no){}, '')"
    return f"""with docs as (select doc_id, coalesce(text, '') as t from documents), m as ({every}),
        s as (select doc_id, no, kind, cast({total.format("parts[1:i]")} + {total.format("w[1:i-1]")} as bigint) as start, length(w[i]) as size from m where length(g[i]) >= {least}),
        f as (select doc_id, no, start, kind || ':' || start || ':' || (start + size) as span from s)
        select doc_id, count(case when no = 0 then 1 end) as n_assign, count(case when no = 1 then 1 end) as n_access, count(case when no = 2 then 1 end) as n_hex,
        sha256({text.format(f" filter (no < {secrets.BASE_KINDS})")}) as base_sha256, {text.format(" filter (no is not null)")} as spans
        from docs left join f using (doc_id) group by doc_id"""


CHAT_SQL = """with c as (select conv_id, count(*) as n, list({'r': role, 'x': text} order by turn, role, text) as l from conversations where conv_id is not null group by 1),
    k as (select min(conv_id) as conv_id, n as n_turns, count(*) as n_same, l from c group by n, l),
    m as (select * from k a where not exists (select 1 from c b where b.n > a.n_turns and b.l[1:a.n_turns] = a.l)),
    o as (select conv_id, n_turns, n_same, array_to_string(list_transform(l, lambda s: '<|' || replace(coalesce(s.r, ''), '<|', '<||') || '|>' || chr(10) || replace(coalesce(s.x, ''), '<|', '<||') || '<|end|>' || chr(10)), '') as t from m)
    select conv_id, n_turns, n_same, length(t) as n_chars, sha256(t) as sha256 from o"""

#: The manifest in SQL: trees grow upward, a leaf's siblings are read off level by level, the fold climbs with them.
MERKLE_SQL = """with recursive d as (select doc_id, lang, n_chars, text, source, case when n_chars is not null and
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint) % 7 = 0 then 1 else 0 end as bad from documents),
    f as (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as a,
        coalesce(strlen(text) || ':' || text, '-') as z from d),
    g as (select doc_id, lang, sha256(a || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) as leaf,
        sha256(a || coalesce(strlen((n_chars + bad)::varchar) || ':' || (n_chars + bad), '-') || z) as bent from f),
    l as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n, row_number() over (order by lang nulls first, doc_id nulls first, leaf) as k from g),
    u as (select lang, 0 as lev, pos, n, leaf as h from l union all
        select lang, lev + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by pos)) from u where n > 1 group by lang, lev, pos // 2),
    s as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from u where n = 1),
    t as (select 0 as lev, pos, n, subroot as h from s union all select lev + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by lev, pos // 2),
    q as (select k, u.lev as lev, (l.pos >> u.lev) & 1 as side, u.h as h from l join u on u.lang is not distinct from l.lang and u.pos = xor(l.pos >> u.lev, 1)
        union all select k, 1000 + t.lev, (s.pos >> t.lev) & 1, t.h from l join s on s.lang is not distinct from l.lang join t on t.pos = xor(s.pos >> t.lev, 1)),
    w as (select k, d1.lev as lev from l join (select distinct lang, lev from u where n > 1) d1 on d1.lang is not distinct from l.lang union all select k, 1000 + lev from l, (select distinct lev from t where n > 1)),
    p as (select w.k, row_number() over (partition by w.k order by w.lev) as i, side, q.h as h from w left join q on q.k = w.k and q.lev = w.lev),
    c as (select k, 0::bigint as i, bent as h from l union all select c.k, c.i + 1, sha256(case when p.side = 1 then p.h || c.h else c.h || coalesce(p.h, '') end) from c join p on p.k = c.k and p.i = c.i + 1),
    e as (select k, max_by(h, i) as folded_root from c group by k),
    o as (select k, string_agg(h, '' order by i) as proof from p group by k)
    select doc_id, leaf, subroot, (select h from t where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = (select h from t where n = 1) as verified
    from l join s on s.lang is not distinct from l.lang join e using (k) left join o using (k)"""

#: The other queries learn, sketch or run a library's tokenizer; tests hold them against brute force instead.
ORACLE_SQL: dict[str, str] = {"op5_chat_format": CHAT_SQL, "op9_secret_scan": secret_scan_sql(), "op11_merkle_manifest": MERKLE_SQL}
