"""SQL of the operators that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from .digest import BUCKETS, GREATEST, LENGTH_COST, WAYS
from .language import TOP
from .quality import KEEP_SHARE, MAX_DOCS

WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRINGS = """
with d as (select doc_id, row_number() over () as rid, hex(coalesce(text, '')) as h from documents),
win as (select doc_id, rid, i, md5(substring(h, 2 * i + 1, 200)) as g from (select doc_id, rid, h, unnest(range(0, len(h) // 2 - 99)) as i from d)),
again as (select rid, i from (select rid, i, row_number() over (partition by g order by doc_id, i) as r from win) where r > 1),
marked as (select rid, i, sum(fresh) over (partition by rid order by i) as island
  from (select rid, i, case when i <= lag(i) over (partition by rid order by i) + 100 then 0 else 1 end as fresh from again)),
spans as (select rid, min(i) as low, max(i) + 100 as high from marked group by rid, island),
gaps as (select rid, coalesce(lag(high) over (partition by rid order by low), 0) as low, low as high from spans
  union all select d.rid, coalesce(max(high), 0), any_value(len(h)) // 2 from d left join spans s on d.rid = s.rid group by d.rid),
kept as (select g.rid, coalesce(string_agg(substring(h, 2 * low + 1, 2 * (high - low)), '' order by low, high), '') as k from gaps g join d on g.rid = d.rid where high > low group by g.rid),
gone as (select rid, sum(high - low) as n, count(*) as s from spans group by rid)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, cast(coalesce(s, 0) as bigint) as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256
from d left join gone on d.rid = gone.rid left join kept on d.rid = kept.rid
"""

PASSAGES = f"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
win as (select doc_id, rid, i, md5(array_to_string(w[i:i + 49], ' ')) as g from (select doc_id, rid, w, unnest(range(1, len(w) - 48)) as i from d)),
firsts as (select g, min(doc_id) as m from win group by g),
again as (select rid, i from win join firsts on win.g = firsts.g where m < doc_id),
covered as (select distinct rid, unnest(range(i, i + 50)) as p from again),
words as (select rid, p, w[p] as word from (select rid, w, unnest(range(1, len(w) + 1)) as p from d)),
kept as (select words.rid, count(*) as n, string_agg(word, ' ' order by words.p) as k from words left join covered c on words.rid = c.rid and words.p = c.p where c.p is null group by words.rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from d left join kept on d.rid = kept.rid
"""

QUALITY = f"""
with d as (select doc_id, row_number() over () as rid, coalesce('s' || source, '') as host, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{WORD}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from d),
win as (select rid, i, w[i:i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
ln as (select rid, host, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '{WORD}') as x from (select rid, host, unnest(lines) as line from w)),
keyed as (select rid, host, substring(md5(array_to_string(x, ' ')), 1, 16) as k, len(x) as m from ln),
common as (select host, k from (select keyed.host, k, md5(t) as h from keyed join d on keyed.rid = d.rid) group by host, k having count(distinct h) > {MAX_DOCS}),
gone as (select rid, sum(m) as n from keyed join common on keyed.host = common.host and keyed.k = common.k group by rid),
b as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(coalesce(gone.n, 0) as bigint) as n_removed_words
  from w left join cov on w.rid = cov.rid left join gone on w.rid = gone.rid),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select *, not base_failed and n_words - n_removed_words >= cast({KEEP_SHARE} as double) * n_words as kept from f
"""

#: crc32 of x.
CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(x) + 1), lambda i: ord(x[i])::bigint)),
  lambda r, c: list_reduce(list_prepend(xor(r, c), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, case when a & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint)"""

LANGUAGE = f"""
with d as (select doc_id, row_number() over () as rid, lang, coalesce({CRC} % 3 = 1, false) as held_out, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\p{{Nl}}\\p{{No}}]+') as words
  from (select *, coalesce(cast(doc_id as varchar), '') as x from documents)),
w as (select rid, word, count(*) as n from (select rid, unnest(words) as word from d) group by rid, word),
v as (select word, ' ' || word || ' ' as p, unnest(range(1, len(word) + 2)) as i, len(word) as l from (select distinct word from w)),
grams as (select word, k, count(*) as c from (
    select word, ord(p[i + 1])::bigint as k from v where i <= l
    union all select word, ord(p[i])::bigint + ord(p[i + 1])::bigint * 2097152 from v
    union all select word, ord(p[i])::bigint + ord(p[i + 1])::bigint * 2097152 + ord(p[i + 2])::bigint * 4398046511104 from v where i <= l) group by word, k),
docs as (select rid, k, sum(n * c) as f from w join grams on w.word = grams.word group by rid, k),
tops as (select * from (select rid, k, row_number() over (partition by rid order by f desc, k) - 1 as r from docs) where r < {TOP}),
langs as (select lang, k, sum(f) as f from docs join d on docs.rid = d.rid where not held_out and lang is not null group by lang, k),
profiles as (select * from (select lang, k, row_number() over (partition by lang order by f desc, k) - 1 as r from langs) where r < {TOP}),
away as (select t.rid, l.lang, sum(case when p.k is null then {TOP} else abs(t.r - p.r) end) as s, count(*) as n
  from tops t cross join (select distinct lang from profiles) l left join profiles p on p.lang = l.lang and p.k = t.k group by t.rid, l.lang),
best as (select * from (select *, row_number() over (partition by rid order by s, lang) as b from away) where b = 1)
select doc_id, held_out, coalesce(best.lang, 'und') as lang_pred, coalesce(1.0::double - s::double / ({TOP} * n)::double, 0.0::double) as score
from d left join best on d.rid = best.rid and len(list_filter(d.words, lambda z: regexp_matches(z, '\\pL'))) > 0
"""

M32 = 1 << 32


def _bucket(j: int, k: int, salt: int) -> str:
    """The bucket of a byte, the j-th and the k-th after it, as in digest.bucket_counts."""
    h = f"((b[i] * {0x9E3779B1} + b[i + {j}] * {0x85EBCA77}) % {M32})"
    h = f"((xor({h}, {h} >> 15) + b[i + {k}] * {0xC2B2AE3D} + {0x27D4EB2F * (salt + 1) % M32}) % {M32})"
    return f"case when i + {k} <= len(b) then (({h} * {0x2C1B3C6D}) % {M32}) >> 25 end"


def _likeness(a: str, b: str) -> str:
    cost = f"list_sum(list_transform(list_zip({a}.codes, {b}.codes), lambda z: case abs(z[1] - z[2]) when 0 then 0 when 1 then 1 when 2 then 2 else 6 end))"
    return f"1.0::double - ({cost} + least({LENGTH_COST}, abs({a}.size - {b}.size)))::double / {GREATEST}::double"


DIGESTS = f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id desc) as r, count(*) over () as n from documents),
e as (select d.*, substr(d.t, 1, length(d.t) - length(d.t) // 2) || substr(f.t, 1, length(d.t) // 2) as x from d join d f on f.r = d.r % d.n + 1),
texts as (select r, 0 as kind, t as s from e union all select r, 1, x from e),
bytes as (select r, kind, list_transform(regexp_extract_all(hex(s), '..'), lambda z: ('0x' || z)::bigint) as b from texts),
hits as (select r, kind, unnest([{", ".join(_bucket(j, k, salt) for salt, (j, k) in enumerate(WAYS))}]) as bucket from (select r, kind, b, unnest(range(1, len(b) - 1)) as i from bytes)),
counts as (select r, kind, bucket, count(*) as c from hits where bucket is not null group by r, kind, bucket),
filled as (select a.r, a.kind, k.bucket, coalesce(c, 0) as c from bytes a cross join (select unnest(range(0, {BUCKETS})) as bucket) k left join counts on counts.r = a.r and counts.kind = a.kind and counts.bucket = k.bucket),
cuts as (select r, kind, list_sort(list(c)) as q from filled group by r, kind),
coded as (select f.r, f.kind, bucket, (c > q[{BUCKETS // 4}])::int + (c > q[{BUCKETS // 2}])::int + (c > q[{3 * BUCKETS // 4}])::int as code from filled f join cuts on f.r = cuts.r and f.kind = cuts.kind),
whole as (select coded.r, coded.kind, list(code order by bucket) as codes, any_value(least(255, round(8 * log2(len(b) + 1)))::int) as size
  from coded join bytes on coded.r = bytes.r and coded.kind = bytes.kind group by coded.r, coded.kind),
shown as (select *, printf('%02x', size) || array_to_string(list_transform(range(0, {BUCKETS}, 4), lambda g: printf('%02x', codes[g + 1] * 64 + codes[g + 2] * 16 + codes[g + 3] * 4 + codes[g + 4])), '') as f from whole)
select doc_id, length(t)::bigint as n_chars, sha256(x) as edited_sha256, o.f as fingerprint, m.f as edited_fingerprint, {_likeness("o", "m")} as near_edited, {_likeness("o", "p")} as near_next
from e join shown o on o.r = e.r and o.kind = 0 join shown m on m.r = e.r and m.kind = 1 join shown p on p.r = e.r % e.n + 1 and p.kind = 0
"""

# XXH64 of bytes b of length l (its published definition), in 128-bit arithmetic. A value that is used twice is bound by a lambda.
XX1, XX2, XX3, XX4, XX5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
M64 = 1 << 64


def _u(n: int) -> str:
    return f"{n % M64}::uhugeint"


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _mul(a: str, b: int) -> str:
    return f"(({a}) * {_u(b)} % {M64}::uhugeint)"


def _add(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % {M64}::uhugeint)"


def _turn(name: str, r: int) -> str:
    return f"(({name} * {1 << r}::uhugeint) % {M64}::uhugeint + {name} // {1 << (64 - r)}::uhugeint)"


def _word(place: str, n: int) -> str:
    return "(" + " + ".join(f"b[({place}) + {k + 1}]::uhugeint * {256**k}::uhugeint" for k in range(n)) + ")"


def _round(state: str, lane: str) -> str:
    return _let(_add(state, _mul(lane, XX2)), "t", _mul(_turn("t", 31), XX1))


def _xxh64(seed: int) -> str:
    def fold(start: str, places: str, word: str, factor: int, turn: int, then: int, plus: int) -> str:
        mixed = _round("0::uhugeint", word) if factor == 0 else _mul(word, factor)
        step = _let(f"xor(a, {mixed})", "u", _add(_mul(_turn("u", turn), then), _u(plus)))
        return f"list_reduce(list_prepend({start}, range({places})::uhugeint[]), lambda a, o: {step})"

    lanes = [
        f"list_reduce(list_prepend({_u(v)}, range(0, l // 32)::uhugeint[]), lambda a, s: {_round('a', _word(f's::bigint * 32 + {8 * i}', 8))})"
        for i, v in enumerate((seed + XX1 + XX2, seed + XX2, seed, seed - XX1))
    ]
    joined = _add(*[_turn(f"v[{i + 1}]", r) for i, r in enumerate((1, 7, 12, 18))])
    merged = _add(_mul(f"xor(a, {_round('0::uhugeint', 'w')})", XX1), _u(XX4))
    long = _let("[" + ", ".join(lanes) + "]", "v", f"list_reduce(list_prepend({joined}, v), lambda a, w: {merged})")
    h = _add(f"case when l >= 32 then {long} else {_u(seed + XX5)} end", "l::uhugeint")
    h = fold(h, "l // 32 * 32, l // 8 * 8, 8", _word("o::bigint", 8), 0, 27, XX1, XX4)
    h = fold(h, "l // 8 * 8, l // 4 * 4, 4", _word("o::bigint", 4), XX1, 23, XX2, XX3)
    h = fold(h, "l // 4 * 4, l", "b[o::bigint + 1]::uhugeint", XX5, 11, XX1, 0)
    for name, shift, factor in (("x", 33, XX2), ("y", 29, XX3)):
        h = _let(h, name, _mul(f"xor({name}, {name} // {1 << shift}::uhugeint)", factor))
    return _let(h, "z", f"xor(z, z // {1 << 32}::uhugeint)")


SIMHASH = f"""
with recursive d as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
grams as (select rid, array_to_string(w[i:i + 3], ' ') as g from (select rid, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) as i from d)),
kinds as (select g, list_transform(regexp_extract_all(hex(g), '..'), lambda z: ('0x' || z)::bigint) as b, (len(hex(g)) // 2)::bigint as l from (select distinct g from grams)),
hashed as (select g, ({_xxh64(42)})::ubigint as h from kinds),
bits as (select rid, count(*) as n, {", ".join(f"sum((h >> {k}) & 1) as s{k}" for k in range(64))} from grams join hashed on grams.g = hashed.g group by rid),
prints as (select d.rid, doc_id, coalesce(({" + ".join(f"(case when 2 * s{k} > n then {1 << k} else 0 end)::hugeint" for k in range(64))})::ubigint, 0::ubigint) as f from d left join bits on d.rid = bits.rid),
links as (select a.f as x, b.f as y from (select distinct f from prints) a join (select distinct f from prints) b on bit_count(xor(a.f, b.f)::bit) <= 4),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
firsts as (select f, min(doc_id) as m from prints group by f),
comps as (select x, min(m) as c from reach join firsts on y = f group by x)
select doc_id, lpad(lower(hex(f)), 16, '0') as fingerprint, c as component_id from prints join comps on f = x
"""

ORACLE_SQL = {"op9_simhash": SIMHASH, "op10_quartile_digest": DIGESTS, "op3_rank_order_language": LANGUAGE, "op2_suffix_dedup": SUBSTRINGS, "op5_line_quality": QUALITY, "op6_phrase_automata": PASSAGES}
