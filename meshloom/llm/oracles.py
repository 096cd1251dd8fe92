"""DuckDB SQL for the queries that SQL can express.

The classifiers, the language model, the shards, the token files and the
fingerprints have none: tests hold them against brute force or labels."""

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"'[^\x20\x09-\x0D]+'"
BENCH = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP6 = f"""
with d as (select doc_id, coalesce(regexp_extract_all({FOLD.format('text')}, {BENCH}), []) w from documents),
b as (select item_id, coalesce(regexp_extract_all({FOLD.format('text')}, {BENCH}), []) w from benchmark),
win as (select item_id, w[i : i + 12] g from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) i from b where len(w) > 0)),
lens as (select distinct len(g) n from win),
pos as (select doc_id, i, w[i : i + n - 1] g, n from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, lens where len(w) >= n)),
hit as (select distinct doc_id, i, item_id, p.n from pos p join win using (g)),
cov as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + n)) k from hit) group by 1),
it as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from hit) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated from d left join cov using (doc_id) left join it using (doc_id)
"""

OP7 = """
with p as (select page_id, coalesce(html, '') h from pages), k as (select *, max(page_id) over (partition by h) keep, sha1(h) x from p)
select page_id, octet_length(encode(h))::bigint payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') payload_digest,
case when page_id = keep then 'response' else 'revisit' end record_type, case when page_id = keep then null else keep end refers_to from k
"""


def _hash(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, 'null')), 1, 7))::bigint"


OP9 = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, {PLAIN})), 0)::bigint size from documents),
s as (select source, sum(size)::bigint n, (row_number() over (order by source nulls last) - 1) % 3 + 1 w from d group by source),
o as (select *, sum(n) over ()::bigint total, 3 * n / w r from s),
l as (select *, (total - coalesce(sum(3 * n) over (order by r, source nulls last rows between unbounded preceding and 1 preceding), 0))::double / (sum(w) over (order by r, source nulls last rows between current row and unbounded following))::double lv from o),
t as (select source, n, total, least(3.0::double * n, coalesce(max(case when lv <= r then lv end) over () * w, 0.0::double)) target from l),
q as (select source, target / (2 * k - 1) v, k from t, range(1, 1 + (select round(sum(size) / 64)::bigint from d)) x(k)),
won as (select source, count(*) blocks from (select source, row_number() over (order by v desc, source nulls last, k) p from q where v > 0) where p <= (select round(sum(size) / 64)::bigint from d) group by 1),
u as (select t.source, n, target, least(coalesce(blocks, 0) * 64, 3 * n) words from t left join won on t.source is not distinct from won.source),
z as (select *, case when n > 0 then words // n else 0 end whole, case when n > 0 then words % n else words end rest, greatest(1, ceil(n / 1048576))::bigint shards from u),
e as (select d.doc_id, d.source, d.size, z.n, z.target, z.whole, z.rest, {_hash(20240607)} % shards shard, {_hash(20240608)} place from d join z on d.source is not distinct from z.source),
h as (select source, shard, rest, sum(size)::bigint n, round(rest / 64)::bigint seats from e group by 1, 2, 3),
hq as (select source, shard, seats, n / (2 * k - 1) v, k from h, lateral (select unnest(range(1, seats + 1)) k)),
hw as (select source, shard, count(*) blocks from (select source, shard, seats, row_number() over (partition by source order by v desc, shard, k) p from hq where v > 0) where p <= seats group by 1, 2),
c as (select h.source, h.shard, least(coalesce(blocks, 0) * 64, h.n) quota from h left join hw on h.source is not distinct from hw.source and h.shard = hw.shard)
select doc_id, size, n source_size, target, (whole * size + greatest(0, least(size, quota - (sum(size) over (partition by e.source, e.shard order by place, doc_id, size rows unbounded preceding) - size))))::bigint taken
from e join c on e.source is not distinct from c.source and e.shard = c.shard
"""

OP10 = f"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({FOLD.format('text')}, {PLAIN}), []) w from documents),
s as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i : i + 4], ' ') else array_to_string(w, ' ') end g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
arcs as (select a src, b dst from l union all select b, a from l),
cc(doc_id, c) using key (doc_id) as (select doc_id, doc_id from d union select doc_id, m from (select dst doc_id, min(c) m from cc join arcs on src = cc.doc_id group by 1) x where exists (select 1 from recurring.cc r where r.doc_id = x.doc_id and x.m < r.c))
select d.doc_id, coalesce(n.n, 0) n_shingles, c component_id from d left join n using (doc_id) join cc using (doc_id)
"""

OP11 = f"""
with d as (select coalesce(lang, 'und') lang, unnest(string_split_regex({FOLD.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from d),
t as (select lang, sum(len(w))::bigint n from p group by 1),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from p, (values (1), (2), (3), (4)) x(k) where len(w) >= k)),
f as (select lang, phrase, any_value(k) k, count(*) a from g group by 1, 2 having count(*) >= 30),
c as (select lang, phrase, k, a, c, array_to_string(string_split(phrase, ' ')[1 : c], ' ') lp, array_to_string(string_split(phrase, ' ')[c + 1 :], ' ') rp from (select *, unnest(range(1, k)) c from f where k > 1)),
s as (select c.lang, c.phrase, c.k, c.a, x.a l, y.a r, c, ((c.a::hugeint * 2000000) // (x.a + y.a))::bigint score from c join f x on x.lang = c.lang and x.phrase = lp join f y on y.lang = c.lang and y.phrase = rp),
b as (select lang, phrase, k, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, c) = 1),
i as (select lang, sub, max(a) most from (select lang, a, array_to_string(w[q : q + n - 1], ' ') sub from (select *, unnest(range(1, k - n + 2)) q from (select lang, a, k, string_split(phrase, ' ') w, unnest(range(2, k)) n from b where k > 2))) group by 1, 2),
k as (select b.* from b left join i on i.lang = b.lang and i.sub = b.phrase where most is null or 100 * most < 80 * b.a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from k)
select r.lang, rank, phrase, a, l, r, n, score from r join t using (lang) where rank <= 2000
"""

OP13 = f"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') x, coalesce(regexp_extract_all(text, {PLAIN}), []) w from documents),
l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
m as (select part, x, coalesce(good, 0) good, coalesce(toxic, 0) toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by x), false)] f from d left join l using (doc_id)),
c as (select part, f, count(*) n, sum(good) good, sum(toxic) toxic from m group by 1, 2),
p as (select [a, b, c, d, e] o from (values (1), (2), (3), (4), (5)) q(a), (values (1), (2), (3), (4), (5)) r(b), (values (1), (2), (3), (4), (5)) s(c), (values (1), (2), (3), (4), (5)) t(d), (values (1), (2), (3), (4), (5)) u(e) where len(list_distinct([a, b, c, d, e])) = 5),
j as (select part, o, unnest(range(1, 6)) step, f, n, good, toxic from c, p),
k as (select *, f[o[step]] hit, len(list_filter(o[1 : step - 1], lambda i: f[i])) before, len(list_filter(f, lambda i: i)) fails from j),
r as (select part, o, step, sum(case when before = 0 and not hit then n else 0 end)::bigint kept, sum(case when before = 0 and hit then n else 0 end)::bigint removed, sum(case when before > 0 and hit then n else 0 end)::bigint redundant,
sum(case when hit and fails = 1 then n else 0 end)::bigint unique_fails, sum(case when before = 0 and hit then good else 0 end)::bigint good_lost, sum(case when before = 0 and hit then toxic else 0 end)::bigint toxic_lost from k group by 1, 2, 3)
select part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, o[step]))::bigint shapley from r
"""

ORACLES: dict[str, str] = {"op6_decontamination": OP6, "op7_warc": OP7, "op9_mixing": OP9, "op10_jaccard_join": OP10, "op11_collocations": OP11, "op13_filter_audit": OP13}
