"""The same queries in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

import random

from quern.functions.text import END_OF_TEXT
from quern.plans.catalog import BATCH, CHUNKS, CONTEXT, FEW_MERGES, MERGES, RATES, SAMPLE, SEED

#: The 25 white-space code points of Unicode, for a pattern engine whose \s is ASCII.
SPACE = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# RE2 has no look-ahead: a private mark goes before the last space of a run that text follows.
MARKED = f"regexp_replace(text, '([{SPACE}]+)([{SPACE}][^{SPACE}])', '\\1'||chr(57344)||'\\2', 'g')"
WORDS = rf"regexp_extract_all({MARKED}, '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}\x{{E000}}]+|[{SPACE}]+')"

COUNTS = f"pc as (select w, count(*) n from (select unnest({WORDS}) w from documents) group by w)"
BRACKETS = "regexp_replace(hex(encode(w)), '(..)', '<\\1>', 'g')"


def _learn(k: int, word: str = "") -> str:
    """Merges as a recursive table r: after ``it`` merges, every word's segments and the last pair."""
    w, rw = (", w", ", r.w") if word else ("", "")
    return f"""{COUNTS},
w0 as (select {BRACKETS} s, n{w} from pc),
r(it, s, n{w}, bl, br) as (
  select 0, s, n::hugeint{w}, '', '' from w0
  union all
  (with pr as (select unnest(list_zip(string_split(s[2:-2], '><')[:-2], string_split(s[2:-2], '><')[2:])) p, n from r where s like '%><%'),
   best as (select p[1] l, p[2] r, sum(n) c from pr group by 1, 2 order by c desc, l desc, r desc limit 1)
   select it + 1, replace(r.s, '<'||best.l||'><'||best.r||'>', '<'||best.l||best.r||'>'), n{rw}, best.l, best.r from r, best where it < {k}))"""


MERGE_ROWS = "m as (select it, any_value(bl) l, any_value(br) r from r where it > 0 group by it)"
DOC_WORDS = f"dw as (select doc_id, lang, source, unnest(a) w, unnest(range(len(a)))::int pos from (select *, {WORDS} a from documents))"

WORD_IDS = f"""ids as (select printf('%02X', i) h, i::int id from range(256) x(i) union all select l||r, 255 + it from m),
ws as (select w, n, unnest(a) h, unnest(range(len(a))) p from (select w, n, string_split(s[2:-2], '><') a from r where it = {MERGES})),
wi as (select w, any_value(n) n, count(*) k, string_agg(id, ' ' order by p) ids from ws join ids using (h) group by w)"""


def _total(it: int) -> str:
    return f"(select sum(n * len(string_split(s, '><'))) from r where it = {it} and s != '')"


SQUASH = "array_to_string(list_transform({}, lambda v: round(v * 1e6)::bigint), ' ')"
VEC = "(select vec_id, label, list_transform(embedding, lambda v: v::double) x from embeddings)"
SHIFTED = "list_transform(x, lambda v: exp(v - list_max(x)))"

def _reservoirs(totals: tuple[int, ...]) -> str:
    """Rows (total, ordinal, slot): what a plain loop over so many documents holds at its end."""
    rows = []
    for total in totals:
        rng, held = random.Random(SEED), []
        for seen in range(1, total + 1):
            if seen <= SAMPLE:
                held.append(seen - 1)
            elif (j := rng.randrange(seen)) < SAMPLE:
                held[j] = seen - 1
        rows += [f"({total}, {ordinal}, {slot})" for slot, ordinal in enumerate(held)]
    return ", ".join(rows)


#: Documents in the three sizes of the tables.
TOTALS = (200, 1_000, 10_000)

SQL: dict[str, str] = {
    "pretoken_stream": f"select doc_id, unnest(range(len(a)))::int pos, unnest(a) pretoken from (select doc_id, {WORDS} a from documents)",
    "pretoken_counts": f"with {COUNTS} select w pretoken, n from pc",
    "special_split": f"""with t as (select doc_id, replace(text, chr(10), '{END_OF_TEXT}') t from documents),
u as (select doc_id, string_split(t, '{END_OF_TEXT}') p from t),
v as (select doc_id, flatten(list_transform(p, lambda x, i: case when i < len(p) then [x, '{END_OF_TEXT}'] else [x] end)) q from u),
f as (select doc_id, list_filter(q, lambda x: x != '') q from v)
select doc_id, unnest(range(len(q)))::int pos, unnest(q) part from f""",
    "corpus_split": "select * from (select doc_id, unnest(string_split(text, chr(10))) as text from documents) where trim(text, chr(13)||chr(10)) != ''",
    "byte_pair_counts": f"""with {COUNTS}, h as (select string_split(trim(regexp_replace(hex(encode(w)), '(..)', '\\1 ', 'g')), ' ') a, n from pc),
p as (select unnest(list_zip(a[:-2], a[2:])) p, n from h where len(a) > 1)
select p[1] as "left", p[2] as "right", sum(n)::bigint c from p group by 1, 2""",
    "best_pair": f"""with {COUNTS}, h as (select string_split(trim(regexp_replace(hex(encode(w)), '(..)', '\\1 ', 'g')), ' ') a, n from pc),
p as (select unnest(list_zip(a[:-2], a[2:])) p, n from h where len(a) > 1)
select p[1] as "left", p[2] as "right", sum(n)::bigint c from p group by 1, 2 order by c desc, 1 desc, 2 desc limit 1""",
    "inverted_index": f"""with {COUNTS}, h as (select string_split(trim(regexp_replace(hex(encode(w)), '(..)', '\\1 ', 'g')), ' ') a from pc),
p as (select unnest(list_zip(a[:-2], a[2:])) p from h where len(a) > 1)
select p[1] as "left", p[2] as "right", count(*) n_places from p group by 1, 2""",
    "bpe_merges": f"with recursive {_learn(MERGES)}, {MERGE_ROWS} select it, l, r from m",
    "bpe_merges_local": f"with recursive {_learn(MERGES)}, {MERGE_ROWS} select it, l, r from m",
    "bpe_merges_500": f"with recursive {_learn(243).replace('from documents', 'from benchmark')}, {MERGE_ROWS} select it, l, r from m",
    "files_roundtrip": f"""with recursive {_learn(MERGES)}, {MERGE_ROWS}
select i::int token_id, printf('%02X', i) as token, null::int as rank from range(256) t(i)
union all select {256 + MERGES}, hex(encode('{END_OF_TEXT}')), null union all select 255 + it, l||r, (it - 1)::int from m""",
    "tokens_file": """with b as (select item_id, hex(encode(text)) h from benchmark), t as (select item_id, unnest(range(0, length(h) // 2)) k, h from b),
i as (select item_id, k, ('0x'||substr(h, (2 * k + 1)::int, 2))::int v from t union all select item_id, 1000000000, 256 from benchmark),
p as (select v, row_number() over (order by item_id, k) - 1 pos from i) select pos // 16 as run, sum(v)::bigint total, count(*) n from p group by 1""",
    "whole_files": """with c as (select item_id, replace(text, chr(10), chr(13)) t from benchmark),
s as (select item_id, t, string_split(t, '')[1:40] a from c), z as (select *, list_transform(a, lambda x: octet_length(encode(x))) z from s),
p as (select *, list_transform(range(1, len(a) + 1), lambda i: coalesce(list_sum(z[1:i - 1]), 0)) b from z)
select item_id, replace(t, chr(13), chr(10))||chr(10) as text, array_to_string(list_filter(list_transform(range(1, len(a) + 1), lambda i: case when b[i] >= 3 and b[i] + z[i] <= 23 then a[i] else '' end), lambda x: x != ''), '') part from p""",
    "reservoir_sample": f"""with u as (select doc_id, trim(text, chr(13)||chr(10)) as text from documents), v as (select doc_id, text, row_number() over (order by doc_id) - 1 ordinal, count(*) over () total from u where text != ''),
s(total, ordinal, slot) as (values {_reservoirs(TOTALS)}) select slot::int slot, doc_id, v.text as text from v join s using (total, ordinal)""",
    "pair_words": f"""with {COUNTS}, h as (select hex(encode(w)) w, string_split(trim(regexp_replace(hex(encode(w)), '(..)', '\\1 ', 'g')), ' ') a from pc),
p as (select w as word, unnest(list_zip(a[:-2], a[2:])) p from h where len(a) > 1) select distinct p[1]||p[2] as pair, word from p""",
    "special_drop": f"with {COUNTS.replace('from documents', 'from (select unnest(string_split(text, chr(10))) as text from documents)')} select w pretoken, n from pc",
    "bpe_roundtrip_large": f"select doc_id, replace(text, chr(10), '{END_OF_TEXT * 2}') as text from documents",
    "training_metrics": f"""with recursive {_learn(MERGES)}, {MERGE_ROWS}, t as (select l||r tok, 255 + it id from m order by length(l||r) desc, it limit 1)
select {256 + MERGES}::int vocab_size, {MERGES}::int n_merges, count(*) n_docs, sum(octet_length(encode(text)))::bigint input_bytes, any_value(tok) longest_token, (length(any_value(tok)) // 2)::int longest_bytes from documents, t""",
    "decode_range": """with c as (select doc_id, string_split(text, '')[1:60] a from documents), s as (select doc_id, a, list_transform(a, lambda x: octet_length(encode(x))) z from c),
p as (select doc_id, a, z, list_transform(range(1, len(a) + 1), lambda i: coalesce(list_sum(z[1:i - 1]), 0)) b from s)
select doc_id, array_to_string(list_filter(list_transform(range(1, len(a) + 1), lambda i: case when b[i] >= 5 and b[i] + z[i] <= 45 then a[i] else '' end), lambda x: x != ''), '') part from p""",
    "lm_drawn": f"""with b as (select doc_id, encode(text) e from documents), s as (select doc_id, unnest(range(0, octet_length(e) - {CONTEXT})) "start" from b),
d as (select * from s order by md5('{SEED}|'||doc_id||'|'||"start"), doc_id, "start" limit {BATCH}),
h as (select doc_id, "start", hex(e) h from d join b using (doc_id)),
i as (select doc_id, "start", list_transform(range(0, {CONTEXT} + 1), lambda k: ('0x'||substr(h, (2 * ("start" + k) + 1)::int, 2))::int) a from h)
select doc_id, "start"::bigint as "start", array_to_string(a[1:{CONTEXT}], ' ') x, array_to_string(a[2:{CONTEXT} + 1], ' ') y from i""",
    "bpe_vocab": f"""with recursive {_learn(MERGES)}, {MERGE_ROWS}
select i::int token_id, printf('%02X', i) as token from range(256) t(i)
union all select 256, hex(encode('{END_OF_TEXT}')) union all select 256 + it, l||r from m""",
    "bpe_words": f"with recursive {_learn(MERGES, 'w')}, {MERGE_ROWS}, {WORD_IDS} select ids, n::bigint n from wi",
    "bpe_encode_docs": f"""with recursive {_learn(MERGES, "w")}, {DOC_WORDS}, {MERGE_ROWS}, {WORD_IDS},
t as (select doc_id, sum(k)::bigint n_tokens, md5(string_agg(ids, ' ' order by pos)) ids_md5 from dw join wi using (w) group by 1)
select doc_id, coalesce(n_tokens, 0) n_tokens, coalesce(ids_md5, md5('')) ids_md5 from documents left join t using (doc_id)""",
    "bpe_roundtrip": "select doc_id, text from documents",
    "decode_unknown": "select n_nationkey doc_id, chr(n_nationkey + 65)||chr(65533)||chr(65533)||'B' as text from nation",
    "compression_by_lang": f"""with recursive {_learn(MERGES, "w")}, {DOC_WORDS}, e as (select w, len(string_split(s, '><')) k from r where it = {MERGES}),
t as (select lang, sum(k)::bigint num_tokens from dw join e using (w) group by 1), b as (select lang, sum(octet_length(encode(text)))::bigint input_bytes from documents group by 1)
select lang, input_bytes, num_tokens, round(input_bytes / num_tokens, 6) bytes_per_token from b join t using (lang)""",
    "tokenizer_compare": f"""with recursive {_learn(MERGES)}, b as (select sum(octet_length(encode(text)))::double b from documents),
x as (select b / {_total(FEW_MERGES)}::double f, b / {_total(MERGES)}::double g from b)
select round(f, 6) as "first", round(g, 6) as "second", round((g - f) * 100 / f, 4) as "percent", case when g > f then 'better' when g < f then 'worse' else 'equal' end verdict from x""",
    "tokenization_summary": f"""with recursive {_learn(MERGES, "w")}, {DOC_WORDS}, e as (select w, len(string_split(s, '><')) k from r where it = {MERGES}),
t as (select source, sum(k)::bigint k from dw join e using (w) group by 1), b as (select source, count(*) d, sum(octet_length(encode(text)))::bigint input_bytes from documents group by 1)
select source as name, (k + d)::bigint num_tokens, input_bytes, round(input_bytes / (k + d), 6) bytes_per_token from b join t using (source)""",
    "token_array": f"""with recursive {_learn(MERGES, "w")}, {DOC_WORDS}, {MERGE_ROWS},
ids as (select printf('%02X', i) h, i::int id from range(256) x(i) union all select l||r, 255 + it from m),
e as (select w, string_split(s[2:-2], '><') a from r where it = {MERGES}),
t as (select doc_id, pos, unnest(a) h, unnest(range(len(a))) k from dw join e using (w)),
z as (select doc_id, pos, k, id from t join ids using (h) union all select doc_id, 2147483647, 0, {256 + MERGES} from documents)
select (row_number() over (order by doc_id, pos, k) - 1) as pos, id token_id from z""",
    "uint16_safe": f"select {255 + MERGES}::int max_id, true safe",
    "longest_tokens": f"""with recursive {_learn(MERGES)}, {MERGE_ROWS}
select token_id, token, (length(token) // 2)::int n_bytes from (select i::int token_id, printf('%02X', i) as token from range(256) t(i) union all select 255 + it, l||r from m) order by n_bytes desc, token_id limit 10""",
    "byte_unicode_map": """with b as (select i::int as byte, (i between 33 and 126 or i between 161 and 172 or i between 174 and 255) seen from range(256) t(i))
select byte, case when seen then chr(byte) else chr((256 + row_number() over (partition by seen order by byte) - 1)::int) end ch from b""",
    "hash_sample": f"""select doc_id, text from (select doc_id, trim(text, chr(13)||chr(10)) as text from documents) where text != ''
order by md5('{SEED}|'||doc_id), doc_id limit {SAMPLE}""",
    "chunk_boundaries": f"""with s as (select octet_length(encode(string_agg(text, '{END_OF_TEXT}' order by doc_id))) size from documents),
d as (select sum(octet_length(encode(text)) + 13) over (order by doc_id) - 13 "at" from documents),
g as (select (size // {CHUNKS}) * i guess, size from s, range(1, {CHUNKS}) t(i))
select distinct boundary::bigint boundary from (select coalesce(min("at"), any_value(size)) boundary from g left join d on "at" >= guess group by guess union all select 0 union all select size from s)""",
    "lm_batches": f"""with b as (select item_id doc_id, list_transform(range(1, length(hex(encode(text))), 2), lambda i: ('0x'||substr(hex(encode(text)), i::int, 2))::int) a from benchmark),
s as (select doc_id, a, unnest(range(0, len(a) - {CONTEXT})) "start" from b)
select doc_id, "start"::bigint as "start", array_to_string(a["start" + 1:"start" + {CONTEXT}], ' ') x, array_to_string(a["start" + 2:"start" + {CONTEXT} + 1], ' ') y from s""",
    "softmax_embeddings": f"with e as (select vec_id, {SHIFTED} e from {VEC}) select vec_id, {SQUASH.format('list_transform(e, lambda v: v / list_sum(e))')} y from e",
    "silu_embeddings": f"select vec_id, {SQUASH.format('list_transform(x, lambda v: v / (1 + exp(-v)))')} y from {VEC}",
    "rmsnorm_embeddings": f"select vec_id, {SQUASH.format('list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda u: u * u)) / len(x) + 1e-5))')} y from {VEC}",
    "cross_entropy_embeddings": f"select label, round(avg(list_max(x) + ln(list_sum({SHIFTED})) - x[vec_id % len(x) + 1]), 6) loss from {VEC} group by 1",
    "linear_embeddings": f"select vec_id, {SQUASH.format('[list_sum(x), list_sum(list_transform(x, lambda v, i: case when i % 2 = 1 then v else -v end))]')} y from {VEC}",
    "swiglu_embeddings": f"""with e as (select vec_id, list_sum(x) a, list_sum(list_transform(x, lambda v, i: case when i % 2 = 1 then v else -v end)) b from {VEC})
select vec_id, {SQUASH.format("[a / (1 + exp(-a)) * a / 2 + 2 * (b / (1 + exp(-b)) * a)]")} y from e""",
    "rope_embeddings": f"""with e as (select x, vec_id, (vec_id % 16)::double p, len(x) // 2 h from {VEC})
select vec_id, {SQUASH.format("list_transform(x, lambda v, i: v * cos(p * power(10000::double, -((i - 1) // 2)::double / h)) + (case when i % 2 = 1 then -x[i + 1] else x[i - 1] end) * sin(p * power(10000::double, -((i - 1) // 2)::double / h)))")} y from e""",
    "attention_embeddings": f"""with e as (select vec_id, x, list_reverse(x) r, sqrt(len(x)) d from {VEC}),
s as (select *, list_sum(list_transform(x, lambda v: v * v)) / d a, list_sum(list_transform(x, lambda v, i: v * r[i])) / d b from e),
m as (select *, greatest(a, b, case when vec_id % 2 = 0 then -a else -1e300 end) m from s), w as (select *, exp(a - m) wa, exp(b - m) wb, case when vec_id % 2 = 0 then exp(-a - m) else 0 end wc from m)
select vec_id, {SQUASH.format("list_transform(x, lambda v, i: (wa * v + wb * r[i] - wc * v) / (wa + wb + wc))")} y from w""",
    "adamw": f"""with e as (select vec_id, unnest(range(len(x)))::int place, unnest(x) x from {VEC}), g as (select *, x * x - 0.1::double g from e),
a as (select *, 0.1::double * g m, 0.001::double * g * g v from g), b as (select *, x * (1 - 0.0005::double) - 0.05::double * (m / 0.1::double) / (sqrt(v / 0.001::double) + 1e-8) y from a),
c as (select *, 0.9::double * m + 0.1::double * g m2, 0.999::double * v + 0.001::double * g * g v2 from b)
select vec_id, place, round(y * (1 - 0.0005::double) - 0.05::double * (m2 / 0.19::double) / (sqrt(v2 / 0.001999::double) + 1e-8), 9) as "value", round(m2, 9) m, round(v2, 9) v from c""",
    "embedding_lookup": f"select n_nationkey, vec_id, {SQUASH.format('x')} y from nation join {VEC} on vec_id = n_nationkey * 7",
    "grad_norm_clip": f"""with n as (select sqrt(sum(list_sum(list_transform(x, lambda v: v * v)))) norm from {VEC})
select vec_id, round(norm, 6) norm, round(list_sum(x) * case when norm > 1 then 1 / (norm + 1e-6) else 1 end, 9) clipped_sum from {VEC}, n""",
    "cosine_lr": f"""select i as step, round(case when i < {RATES["warm_up"]} then i * {RATES["highest"]}::double / {RATES["warm_up"]}
when i <= {RATES["cycle"]} then {RATES["lowest"]} + 0.5::double * (1 + cos((i - {RATES["warm_up"]}) * pi() / {RATES["cycle"] - RATES["warm_up"]})) * {RATES["highest"] - RATES["lowest"]} else {RATES["lowest"]} end::double, 9) lr from range(25) t(i)""",
}
SQL |= {"stream_encode": SQL["bpe_encode_docs"], "metrics_file": SQL["training_metrics"], "summary_file": SQL["tokenization_summary"]}
