"""SQL of the operators' results on whole tables, where SQL can say it."""

from __future__ import annotations

_WORDS = r"(?:[a-z0-9]|[^\x00-\x7F])+"


def _grams(table: str, key: str) -> str:
    """Distinct five-word shingles; a shorter text is one shingle of all its words."""
    return f"""(select distinct {key}, array_to_string(w[i:i + 4], ' ') as g from (select {key}, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i
        from (select {key}, regexp_extract_all(lower(text), '{_WORDS}') as w from {table} where text is not null) where len(w) > 0))"""


#: Items have five words or more in the tables.
CONTAINMENT = f"""
with d as {_grams("documents", "doc_id")}, b as {_grams("benchmark", "item_id")}, n as (select item_id, count(*) as n_item from b group by item_id)
select doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item as containment from d join b using (g) join n using (item_id)
group by doc_id, item_id, n_item having 5 * count(*) >= 4 * n_item
"""

JACCARD = f"""
with recursive g as {_grams("documents", "doc_id")}, n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b, c = x.n and c = y.n as same from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) as (select doc_id, doc_id from documents union select reach.a, links.b from reach join links on links.a = reach.b),
class as (select a as doc_id, min(b) as class_id from reach group by a)
select doc_id, least(doc_id, coalesce((select min(b) from links where a = doc_id and same), doc_id)) as rep_id, class_id, (select count(*) from links where a = doc_id) as n_links, doc_id = class_id as kept
from documents join class using (doc_id)
"""

VECTORS = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 95e-2),
reach(a, b) as (select vec_id, vec_id from v union select reach.a, links.b from reach join links on links.a = reach.b),
class as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from class
"""

WORD_REPEATS = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from w where len(w) >= 50)),
first as (select g, min(doc_id) as d from win group by g),
dup as (select doc_id, i from win join first using (g) where d < doc_id),
pos as (select doc_id, unnest(generate_series(1, len(w))) as i, unnest(w) as word from w),
cov as (select pos.doc_id, pos.i, word, max((dup.i is not null)::int) over (partition by pos.doc_id order by pos.i rows between 49 preceding and current row) as c
    from pos left join dup on dup.doc_id = pos.doc_id and dup.i = pos.i),
kept as (select doc_id, sum(c)::bigint as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where c = 0), '') as k from cov group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from w left join kept using (doc_id)
"""

#: Bytes as two hexadecimal letters each; texts are taken in parts of 256 bytes with the 99 after them, so that no string is cut out of a long text.
BYTE_REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
part as (select doc_id, p, substr(h, 2 * p + 1, 710) as h from (select doc_id, h, unnest(generate_series(0, length(h) // 2 - 100, 256)) as p from d where length(h) >= 200)),
win as (select doc_id, p + i as i, md5(substr(h, 2 * i + 1, 200)) as g from (select doc_id, p, h, unnest(generate_series(0, least(255, length(h) // 2 - 100))) as i from part)),
dup as (select doc_id, i from (select *, row_number() over (partition by g order by doc_id, i) as k from win) where k > 1),
run as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as s from (select doc_id, i, (i > coalesce(lag(i) over (partition by doc_id order by i) + 100, -1))::int as fresh from dup)),
span as (select doc_id, min(i) as lo, max(i) + 100 as hi from run group by doc_id, s),
cut as (select doc_id, count(*) as n, sum(hi - lo)::bigint as gone, list(lo order by lo) as los, list(hi order by hi) as his from span group by doc_id),
kept as (select doc_id, h, coalesce(n, 0) as n, coalesce(gone, 0) as gone, list_concat([0], coalesce(his, [])) as a, list_concat(coalesce(los, []), [length(h) // 2]) as b from d left join cut using (doc_id))
select doc_id, length(h) // 2 as n_bytes, gone as n_removed, n as n_spans, sha256(unhex(array_to_string([substr(h, 2 * a[k] + 1, 2 * (b[k] - a[k])) for k in generate_series(1, len(a))], ''))) as kept_sha256 from kept
"""

ARCHIVES = r"""
with p as (select page_id, coalesce(html, '') as h, regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://', '') as rest from pages),
d as (select page_id, sha256(h) as dig, octet_length(encode(h)) as b,
    array_to_string(list_reverse(string_split(regexp_extract(rest, '^([^/?#]*)', 1), '.')), ',') || ')' || case when regexp_extract(rest, '^[^/?#]*([^#]*)', 1) = '' then '/' else regexp_extract(rest, '^[^/?#]*([^#]*)', 1) end as urlkey from p),
m as (select dig, min(page_id) as first from d where b >= 100 group by dig)
select page_id, b::bigint as payload_bytes, d.dig as payload_digest, case when b >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
    case when b >= 100 and first < page_id then first end as refers_to, urlkey, row_number() over (order by urlkey, page_id) - 1 as history_rank from d left join m on m.dig = d.dig
"""

#: CRC-32 bit by bit (fixed value: its reversed polynomial); near words by the letter that is taken out of one or of both.
VARIANTS = r"""
with recursive tab as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t from range(256) r(i)),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
per_run as (select doc_id, run, count(*) as c, flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [195::bigint, (ord(x) - 64)::bigint] end)) as bytes from runs group by doc_id, run),
h as (select run, c, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda s, b: xor(s // 256, t[xor(s % 256, b) + 1]))) as h from per_run, tab),
cut as (select c, case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from h),
v as (select word, sum(c)::bigint as n from cut where length(word) >= 6 group by word having sum(c) >= 5),
gone as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as d from (select *, unnest(range(1, length(word) + 1)) as i from v)),
pairs as (select a.word, b.word as other, b.n as m from gone a join v b on b.word = a.d union select b.word, a.word, a.n from gone a join v b on b.word = a.d
    union select a.word, b.word, b.n from gone a join gone b on a.d = b.d and a.i = b.i and a.word <> b.word),
best as (select word, count(*) as n_near, max(m) as m, arg_min(other, (-m, other)) as other from pairs group by word),
forms as (select v.word, case when m >= 5 * n then other end as form, n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then m end as form_n from v left join best using (word)),
walk(word, stop) as (select word, word from forms union all select walk.word, f.form from walk join forms f on f.word = walk.stop and f.form is not null)
select forms.word, forms.form, e.stop as root, forms.n, forms.n_near, forms.form_n from forms join (select walk.word, stop from walk join forms f on f.word = walk.stop where f.form is null) e using (word)
"""

RANKED = r"""
with terms as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
size as (select doc_id, count(*) as n from terms group by doc_id),
total as (select count(*) as nn, sum(n)::bigint as ll from size),
tf as (select doc_id, t, count(*) as tf from terms group by doc_id, t),
w as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w from (select t, count(*) as df from tf group by t), total),
asked as (select distinct item_id, t from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)),
scored as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
    from asked join tf using (t) join w using (t) join size using (doc_id), total group by item_id, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 50
"""
