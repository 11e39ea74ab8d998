"""The operators' queries over the tables of a folder, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Weights of the mix: four domains (by the number in a source's name), some languages and sources within them.
MIX_WEIGHTS = {("d0",): 1, ("d1",): 2, ("d2",): 3, ("d3",): 4, ("d0", "en"): 3, ("d1", "fr"): 2, ("d2", "en"): 5, ("d3", "es"): 3,
               ("d1", "en", "src1"): 4, ("d2", "en", "src2"): 3, ("d3", "en", "src3"): 2}
MIX_EPOCHS, MIX_SEED = 2, 1


def mix_domain():
    from pyspark.sql import functions as F

    number = F.expr("try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint)")
    return F.concat(F.lit("d"), (number % 4).cast("string"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from locusframe.llm.mixing import mix

    picks = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, mix_domain(), epochs=MIX_EPOCHS, seed=MIX_SEED)
    return picks.select("row.doc_id", "domain", "row.lang", "row.source", "epoch", F.col("tokens").alias("n_tokens"), F.col("take").alias("taken"))


def _mixing_sql() -> str:
    """The mix in SQL: shares level by level, then one sorted epoch per leaf."""
    def level(keys: list[str], up: list[str], above: str | None) -> str:
        depth, name = len(keys), "_".join(keys)
        given = [(path, w) for path, w in MIX_WEIGHTS.items() if len(path) == depth]
        weight = "case " + " ".join(
            "when " + " and ".join(f"{k} = '{p}'" for k, p in zip(keys, path)) + f" then {w}" for path, w in given) + " else 1 end"
        over = f"partition by {', '.join(up)}" if up else ""
        order = f"{over} order by cap / w, {keys[-1]} rows unbounded preceding"
        budget = f"join b_{above} using ({', '.join(up)})" if above else f"cross join (select sum(tokens)::bigint as budget from leaf)"
        return f"""
        n_{name} as (select {', '.join(keys)}, (sum(tokens) * {MIX_EPOCHS})::bigint as cap, {weight} as w from leaf group by {', '.join(keys)}),
        r_{name} as (select n.*, budget as up, sum(cap) over ({order}) as ccap, sum(w) over ({order}) as cw, sum(w) over ({over}) as aw
            from n_{name} n {budget}),
        f_{name} as (select *, cap::hugeint * (aw - cw + w) <= (up - (ccap - cap)) * w::hugeint as isfull from r_{name}),
        s_{name} as (select *, up - sum(if(isfull, cap, 0)) over ({over}) as rest, sum(if(isfull, 0, w)) over ({over}) as ow,
            sum(if(isfull, 0, w)) over ({order}) as run from f_{name}),
        b_{name} as (select {', '.join(keys)}, (if(isfull, cap, (rest * run) // ow - (rest * (run - w)) // ow))::bigint as budget
            from s_{name})"""

    return f"""
    with sized as (
        select doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint) % 4), '') as domain,
            coalesce(lang, '') as dlang, coalesce(source, '') as dsource, lang, source,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
    leaf as (select domain, dlang, dsource, sum(n_tokens)::bigint as tokens from sized where n_tokens > 0 group by all),
    {level(['domain'], [], None)}, {level(['domain', 'dlang'], ['domain'], 'domain')},
    {level(['domain', 'dlang', 'dsource'], ['domain', 'dlang'], 'domain_dlang')},
    plan as (select l.*, budget // tokens as whole, budget % tokens as rest from leaf l join b_domain_dlang_dsource using (domain, dlang, dsource)),
    ordered as (
        select s.*, whole, rest, sum(n_tokens) over (partition by domain, dlang, dsource
            order by md5('{MIX_SEED}:' || whole || ':' || coalesce(doc_id::varchar, 'null')), doc_id, n_tokens rows unbounded preceding) - n_tokens as start
        from sized s join plan using (domain, dlang, dsource) where n_tokens > 0)
    select doc_id, domain, lang, source, epoch::int as epoch, n_tokens, n_tokens as taken
    from (select *, unnest(range(whole)) as epoch from ordered)
    union all
    select doc_id, domain, lang, source, whole::int, n_tokens, least(n_tokens, rest - start)::bigint from ordered where start < rest"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.quality_mil import quality, train

    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from locusframe.llm.warc import archive_round_trip

    # pages have no time of capture: one is made from the id
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 61 % 31_536_000)
    index = archive_round_trip(table(spark, sf_dir, "pages"), captured)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured",
                        "url_key", "place")


_WARC_SQL = r"""
    with line as (
        select page_id, html, regexp_replace(coalesce(url, ''), '[\x00-\x1F\x7F]', '%20', 'g') as url from pages),
    parts as (
        select *, regexp_extract(lower(trim(url)), '^(?:([a-z][a-z0-9+.-]*):)?//(?:[^/?#]*@)?([^/?#:\[\]]*)(?::([0-9]*))?([^?#]*)(?:[?]([^#]*))?',
            ['scheme', 'host', 'port', 'path', 'query']) as u from line),
    keyed as (
        select page_id, html, case when coalesce(u.host, '') = '' then lower(url) else
            array_to_string(list_reverse(string_split(regexp_replace(u.host, '^www\.', ''), '.')), ',')
            || case when u.port = '' or (u.scheme = 'http' and try_cast(u.port as int) = 80) or (u.scheme = 'https' and try_cast(u.port as int) = 443) then ''
                else ':' || try_cast(u.port as int) end
            || ')' || coalesce(nullif(u.path, ''), '/') || case when u.query = '' then '' else '?' || u.query end end as url_key from parts),
    payload as (
        select page_id, url_key, sha1(coalesce(html, '')) as h, strlen(coalesce(html, ''))::bigint as payload_bytes from keyed),
    last as (select h, payload_bytes, max(page_id) as first_id, count(*) as n from payload group by all)
    , captures as (select page_id, payload_bytes,
        list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31)::int, 1) for i in range(32)], 'string_agg', '')
            as payload_digest,
        case when n > 1 and first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
        case when n > 1 and page_id is distinct from first_id then first_id end as refers_to,
        strftime(make_timestamp((1704067200 + coalesce(page_id * 61 % 31536000, -1704067200)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as captured, url_key
    from payload join last using (h, payload_bytes))
    select *, row_number() over (order by url_key, captured, page_id nulls first, payload_digest) - 1 as place from captures"""


# Longest text that a tool takes; longer arguments stay whole and aren't valid.
TOOL_QUERY = 1200
TOOL_SCHEMAS = {
    name: {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 8, "maxLength": TOOL_QUERY}, "limit": {"type": "integer", "minimum": 0, "maximum": most}}}
    for name, most in (("search", 20), ("lookup", 22), ("note", 24))}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Chat messages with tool calls, made from plain conversations.

    An assistant turn becomes a call whose arguments come from its text and that needs the call two turns before, from the
    fourth turn on; a later user turn becomes the result of the call before it; other turns stay plain text.
    """
    from pyspark.sql import functions as F

    def call_id(turn):
        return F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))

    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    arguments = F.to_json(F.struct(text.alias("query"), (F.length(text) % 25).alias("limit")))
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("note")), (F.floor(turn / 2) % 3 + 1).cast("int"))
    call = F.to_json(F.struct(F.array(F.struct(
        call_id(turn).alias("id"), F.when(turn >= 4, call_id(turn - 2)).alias("after"),
        F.struct(name.alias("name"), arguments.alias("arguments")).alias("function"))).alias("tool_calls")))
    result = F.to_json(F.struct(call_id(turn - 1).alias("tool_call_id"), text.alias("content")))
    made = F.when(F.col("role") == "assistant", call).when((F.col("role") == "user") & (turn >= 1), result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", made.alias("text"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.tool_calls import extract, link

    calls, results = extract(tool_messages(table(spark, sf_dir, "conversations")))
    return link(calls, results, TOOL_SCHEMAS).drop("errors")


_TOOL_SQL = """
    with recursive calls as (
        select conv_id, 'call_' || conv_id || '_' || turn as call_id, turn, ['search', 'lookup', 'note'][(turn // 2) % 3 + 1] as name,
            coalesce(text, '') as query, length(coalesce(text, '')) % 25 as lim,
            case when turn >= 4 then 'call_' || conv_id || '_' || (turn - 2) end as after
        from conversations where role = 'assistant'),
    results as (
        select conv_id, 'call_' || conv_id || '_' || (turn - 1) as call_id, turn, coalesce(text, '') as content
        from conversations where role = 'user' and turn >= 1),
    deep as (
        select call_id, 0::bigint as depth from calls where after is null or after not in (select call_id from calls)
        union all select c.call_id, d.depth + 1 from calls c join deep d on c.after = d.call_id),
    both_sides as (
        select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, coalesce(c.turn, r.turn) as turn, name,
            coalesce(depth, 0) as depth, case when c.call_id is null then 'orphan' when r.call_id is null then 'unanswered' else 'linked' end as status,
            coalesce(length(query) between 8 and 1200 and lim <= case name when 'search' then 20 when 'lookup' then 22 else 24 end, false) as valid,
            (c.call_id is not null)::bigint as n_calls, (r.call_id is not null)::bigint as n_results,
            '{"after":' || coalesce(to_json(after)::varchar, 'null')
            || ',"arguments":' || case when c.call_id is null then 'null' else '{"limit":' || lim || ',"query":' || to_json(query)::varchar || '}' end
            || ',"id":' || to_json(coalesce(c.call_id, r.call_id))::varchar || ',"name":' || coalesce(to_json(name)::varchar, 'null')
            || ',"result":' || coalesce(to_json(content)::varchar, 'null') || '}' as json
        from calls c full join results r on c.call_id = r.call_id left join deep d on d.call_id = c.call_id)
    select *, row_number() over (partition by conv_id order by depth, turn, call_id) - 1 as position from both_sides"""


def op6_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.prefix_hashes import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.simhash_golay import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from locusframe.llm.multiprobe import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.bpe_automaton import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.toxicity_mil import toxicity, train

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from locusframe.llm.lattice_lm import scores

    # held out: the crc32 of the id's text leaves 2 when divided by 7
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    found = scores(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ~out, F.col("lang"))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.llm.alignment import aligned_counts

    return aligned_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_quality, op4_warc_merge, op5_tool_calls, op6_prefix_hashes, op7_simhash_golay, op8_multiprobe, op9_bpe_automaton, op10_toxicity,
                                                   op11_whitening, op12_lattice_lm, op13_alignment)}
ORACLES: dict[str, str] = {"op1_mixing": _mixing_sql(), "op4_warc_merge": _WARC_SQL, "op5_tool_calls": _TOOL_SQL}
