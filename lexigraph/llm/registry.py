"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op3_decontamination
from .langid import op5_language_id
from .licenses import op9_license_scan
from .merkle import op13_merkle
from .mpegts import op4_media_columns
from .segsample import op2_sentencepiece
from .simhash import op6_simhash
from .suffixes import op8_suffix_dedup
from .toxicity import op1_toxicity
from .urlglobs import HOST_WORDS, PATHS, op11_url_filter
from .warc import op10_warc
from .wavelet import op7_token_ids
from .whitening import op12_whitening


def queries() -> dict:
    found = (
        op1_toxicity, op2_sentencepiece, op3_decontamination, op4_media_columns, op5_language_id, op6_simhash, op7_token_ids, op8_suffix_dedup,
        op9_license_scan, op10_warc, op11_url_filter, op12_whitening, op13_merkle,
    )
    return {f.__name__: f for f in found}


#: Base32 of the SHA-1 is spelled out from the digest's bits.
WARC_SQL = """with b as (select page_id, strlen(html) n, array_to_string(list_transform(string_split(sha1(html), ''), lambda h: lpad(bin(('0x' || h)::integer), 4, '0')), '') bits from (select page_id, coalesce(html, '') html from pages)),
    d as (select page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * substr(bits, 5 * i + 1, 1)::integer + 8 * substr(bits, 5 * i + 2, 1)::integer + 4 * substr(bits, 5 * i + 3, 1)::integer + 2 * substr(bits, 5 * i + 4, 1)::integer + substr(bits, 5 * i + 5, 1)::integer + 1)::bigint, 1)), '') digest from b)
    select page_id, n payload_bytes, digest payload_digest, case when page_id = min(page_id) over (partition by digest) then 'response' else 'revisit' end record_type, case when page_id <> min(page_id) over (partition by digest) then min(page_id) over (partition by digest) end refers_to, true sound from d"""


def _url_sql() -> str:
    """The method's rules as conditions on the host, the path and the query, longest name first."""
    quote = lambda x: x.replace("'", "''")
    words = [(f"host:{w}", f"('.' || host) similar to '(?s).*[.-]{w}.*'") for w in HOST_WORDS]
    paths = [(f"path:{p}", f"(path || query) glob '{quote(p)}'") for p in PATHS]
    ranked = sorted(words + paths, key=lambda x: -len(x[0]))
    case = " ".join(f"when {c} then '{quote(n)}'" for n, c in ranked)
    under = lambda host, path: f"ends_with('.' || host, '.{host}') and starts_with(path, '{path}')"
    return f"""with f as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*([?][^#]*)', 1), '') query from pages),
    r as (select *, case when {under("example.net", "/en/")} then 'example.net/en/' when {under("example.com", "/de/")} then 'example.com/de/' when {under("org", "/fr/")} then 'org/fr/' when {under("net", "/")} then 'net/' end rule, case {case} end word from f)
    select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') or rule is null and word is not null then 'block' else 'allow' end verdict, case when rule is null then word end method_rule from r"""


#: The checksum's bits are spelled out; a proof is the list of preimages from a leaf to the root.
MERKLE_SQL = """with recursive f as (select doc_id, source, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') head, text,
        list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) crc from documents),
    l as (select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf, case when crc & 1 = 1 then sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) end changed from f),
    p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by source) n from l),
    a as (select source, 0 lvl, pos, n, leaf h from p union all select source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from a where n > 1 group by source, lvl, pos // 3, n),
    s as (select source, h subroot, row_number() over (order by source nulls first) - 1 pos, count(*) over () n from a where n = 1),
    b as (select 0 lvl, pos, n, subroot h from s union all select lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from b where n > 1 group by lvl, pos // 3, n),
    u as (select source, lvl, pos // 3 parent, list(h order by pos) hs from a where n > 1 group by all), v as (select lvl, pos // 3 parent, list(h order by pos) hs from b where n > 1 group by all),
    w as (select doc_id, p.source, leaf, p.pos, lvl, hs, (p.pos // power(3, lvl)::bigint) % 3 slot from p join u on p.source is not distinct from u.source and parent = p.pos // power(3, lvl + 1)::bigint
        union all select doc_id, p.source, leaf, p.pos, lvl + 1000, hs, (s.pos // power(3, lvl)::bigint) % 3 from p join s on p.source is not distinct from s.source join v on parent = s.pos // power(3, lvl + 1)::bigint),
    x as (select source, pos, list({'h': '', 'l': array_to_string(hs[1:slot], ''), 'r': array_to_string(hs[slot + 2:], '')} order by lvl) path from w group by source, pos),
    y as (select doc_id, leaf, subroot, (select h from b where n = 1) root, coalesce(path, []) path, coalesce(changed, leaf) begun from p join s on p.source is not distinct from s.source left join x on p.source is not distinct from x.source and p.pos = x.pos),
    z as (select *, list_reduce([{'h': begun, 'l': '', 'r': ''}] || path, lambda c, e: {'h': sha256(e.l || c.h || e.r), 'l': '', 'r': ''}).h folded_root from y)
    select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda e: e.l || e.r), '')) proof_sha256, folded_root, folded_root = root verified from z"""


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": WARC_SQL, "op11_url_filter": _url_sql(), "op13_merkle": MERKLE_SQL}
