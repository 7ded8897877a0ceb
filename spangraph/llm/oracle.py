"""DuckDB SQL that must give the same rows, for the queries that SQL can express on whole tables."""

from __future__ import annotations

import unicodedata

# What each letter of another script looks like, by Unicode's names. This table is for the SQL alone.
LOOKS = {
    "GREEK CAPITAL LETTER": "A=ALPHA B=BETA E=EPSILON Z=ZETA H=ETA I=IOTA K=KAPPA M=MU N=NU O=OMICRON P=RHO T=TAU Y=UPSILON X=CHI J=YOT",
    "GREEK SMALL LETTER": "o=OMICRON v=NU p=RHO",
    "GREEK": "C=CAPITAL_LUNATE_SIGMA_SYMBOL c=LUNATE_SIGMA_SYMBOL j=LETTER_YOT",
    "CYRILLIC CAPITAL LETTER": "A=A B=VE C=ES E=IE G=KOMI_SJE H=EN I=BYELORUSSIAN-UKRAINIAN_I J=JE K=KA M=EM O=O P=ER Q=QA S=DZE T=TE V=IZHITSA W=WE X=HA Y=U Γ=GHE Π=PE Φ=EF",
    "CYRILLIC CAPITAL": "Y=LETTER_STRAIGHT_U",
    "CYRILLIC SMALL LETTER": "a=A c=ES d=KOMI_DE e=IE h=SHHA i=BYELORUSSIAN-UKRAINIAN_I j=JE l=PALOCHKA o=O p=ER q=QA s=DZE v=IZHITSA w=WE x=HA y=U",
    "CYRILLIC LETTER": "I=PALOCHKA",
    "ARMENIAN CAPITAL LETTER": "L=LIWN O=OH S=TIWN U=SEH",
    "ARMENIAN SMALL LETTER": "g=CO h=HO n=VO o=OH q=ZA u=SEH",
    "CHEROKEE LETTER": "A=GO B=YV C=TLI D=A E=GV G=NAH H=MI J=GU K=TSO L=TLE M=LU P=TLV R=E S=DU T=I V=DO W=LA Z=NO",
    "LATIN SMALL LETTER": "g=SCRIPT_G",
}


def _shapes() -> dict[str, str]:
    """Letter to the letter that it looks like."""
    out = {}
    for prefix, pairs in LOOKS.items():
        for pair in pairs.split():
            plain, name = pair.split("=")
            out[unicodedata.lookup(f"{prefix} {name.replace('_', ' ')}")] = plain
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _look_sql() -> str:
    """SQL for the shapes of a text: composed, without invisible characters, with plain widths, ligatures and letters."""
    look = _shapes()
    wide = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFA0)]}
    wide |= {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in (0xFF9E, 0xFF9F)}
    several = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFB00, 0xFB07), *range(0x2160, 0x2180)]}
    shapes = {}
    for c in map(chr, [*range(0x80, 0x590), *range(0x13A0, 0x1400)]):  # letters with accents too
        parts = unicodedata.normalize("NFD", c)
        plain = unicodedata.normalize("NFC", look.get(parts[0], parts[0]) + parts[1:])
        if plain != c and len(plain) == 1 and parts[0] in look:
            shapes[c] = plain
    sql = "regexp_replace(regexp_replace(text, '[\\p{Cf}\\x{34F}\\x{115F}\\x{1160}\\x{3164}\\x{FFA0}\\x{FE00}-\\x{FE0F}]', '', 'g'), '\\p{Zs}', ' ', 'g')"
    sql = f"translate({sql}, {_quoted(''.join(wide))}, {_quoted(''.join(wide.values()))})"
    for c, plain in several.items():
        sql = f"replace({sql}, {_quoted(c)}, {_quoted(plain)})"
    return f"translate(nfc_normalize({sql}), {_quoted(''.join(shapes))}, {_quoted(''.join(shapes.values()))})"


_P3 = r"""
with raw as (
  select repo, commit_id,
         regexp_replace(regexp_replace(regexp_replace(file, '[\\/]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') as file
  from commits where trim(commit_id) <> '' and trim(file) <> ''),
touched as (select distinct repo, commit_id, file from raw where trim(file) <> ''),
fit as (select repo, commit_id from touched group by all having count(*) <= {most}),
kept as (select t.* from touched t join fit f on t.repo is not distinct from f.repo and t.commit_id = f.commit_id),
n as (select repo, count(*) as n from fit group by repo),
one as (select repo, file, count(*) as c from kept group by all),
two as (
  select a.repo, a.file as file_a, b.file as file_b, count(*) as c
  from kept a join kept b on a.repo is not distinct from b.repo and a.commit_id = b.commit_id and a.file < b.file
  group by all having count(*) >= {support}),
scored as (
  select t.repo, t.file_a, t.file_b, t.c, t.c / least(x.c, y.c) as strength, t.c * n.n / (x.c * y.c) as lift,
         t.c * n.n >= 3 * x.c * y.c as often
  from two t join one x on t.repo is not distinct from x.repo and t.file_a = x.file
  join one y on t.repo is not distinct from y.repo and t.file_b = y.file
  join n on t.repo is not distinct from n.repo)
"""

_P4 = """
with ordered as (
  select repo, least(file_a, file_b) as file_a, greatest(file_a, file_b) as file_b, strength, change_count, option_set, mined_at
  from co_change_pair
  where file_a is not null and file_b is not null and file_a <> file_b
    and strength is not null and not isnan(strength) and strength > 0 and strength <= 1),
newest as (
  select * from ordered
  qualify row_number() over (
    partition by repo, file_a, file_b
    order by mined_at desc nulls last, strength desc, change_count desc nulls last, option_set desc nulls last) = 1),
ranked as (
  select *, row_number() over (partition by repo, file_a order by strength desc, change_count desc nulls last, file_b) as rank from newest)
select {columns} from ranked r join (select option_set, max(top_partners) as top_partners from co_change_options group by all) o using (option_set)
where rank <= top_partners
"""

_P1 = """
with sized as (
  select distinct s.vector_index as id, s.spill_path, s.embedding::double[] as e, d.dims
  from spill_vectors s join embedding_vector_spill d on d.path = s.spill_path and len(s.embedding) = d.dims),
good as (
  select * from sized
  where list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0))),
refs as (select spill_path, vector_index, min(coalesce(node_id, '')) as node from cached_embedding_meta where vector_index is not null group by all),
v as (select g.id, g.dims, g.e, r.node from good g join refs r on r.spill_path = g.spill_path and r.vector_index = g.id),
near as (
  select a.id as a, b.id as b, list_cosine_similarity(a.e, b.e) as c
  from v a join v b on a.dims = b.dims and a.node <> b.node),
taken as (
  select a, b from near where c >= 0.88 qualify row_number() over (partition by a order by c desc, b) <= 5)
select distinct least(a, b) as vector_a, greatest(a, b) as vector_b from taken
"""

_P6 = """
select id as node_id, content from (
  select id, content, row_number() over (partition by id order by indexed_at desc nulls last, length(content) desc nulls last, content desc) as r
  from nodes where id is not null) where r = 1 and length(content) > 1200"""

ORACLE = {
    "p1_found": _P1,
    "p9_found": f"""
with looks as (select doc_id, text, {_look_sql()} as look from documents where text is not null and doc_id is not null)
select distinct a.doc_id as doc_a, b.doc_id as doc_b from looks a join looks b on a.look = b.look and a.text <> b.text and a.doc_id < b.doc_id
where regexp_matches(a.look, '[^\\s]')""",
    "p3_found": _P3.format(support=5, most=50) + "select repo, file_a, file_b from scored where often",
    "p3_strength": _P3.format(support=3, most=50)
    + "select repo, file_a, file_b, c as change_count, round(strength, 6) as strength, round(lift, 6) as lift from scored where strength >= 0.3",
    "p3_sweeping": _P3.format(support=5, most=1 << 40) + "select repo, file_a, file_b, c as change_count, round(lift, 6) as lift from scored where often",
    "p6_found": f"select node_id from ({_P6})",
    "p6_rebuilt": f"select node_id, md5(content) as whole, true as within_limit, true as within_overlap, true as no_gap from ({_P6})",
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p4_found": _P4.format(columns="repo, file_a, file_b"),
    "p4_ranked": _P4.format(columns="repo, file_a, file_b, strength, change_count, rank"),
}
