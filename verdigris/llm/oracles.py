"""DuckDB SQL of the queries that SQL can express.

op2, op3, op6, op7 and op8 need trained models, byte-pair encoding, pseudorandom permutations or byte streams; the spans
that the methods of op5 and op10 add need CRC-32 in base 62 and context scores.  Those are tested against plain versions.
"""

from verdigris.llm.chat_format import Template
from verdigris.llm.quality_rules import RULES, mask

_WORD = r"[^\x20\x09-\x0D]+"
_SAID = "</s>[INST] ok [/INST]"


class _Name(str):
    """A column of SQL, in the arithmetic that the rules use."""

    def __rmul__(self, by: int) -> "_Name":
        return _Name(f"{by} * {self}")

    def __lt__(self, other: object) -> "_Name":
        return _Name(f"{self} < {other}")

    def __gt__(self, other: object) -> "_Name":
        return _Name(f"{self} > {other}")


def _escaped(text: str, template: Template) -> str:
    out = f"replace({text}, '%', '%25')"
    for c in template.controls:
        out = f"replace({out}, '{c}', '%{ord(c[0]):02X}{c[1:]}')"
    return out


def _chat() -> str:
    t = Template()
    marks = len(t.opening) + 1 + len(t.closing)
    return f"""with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all values (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}'))
select conv_id, count(*) as n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum({marks} + length(replace({_escaped("role", t)}, chr(10), '%0A')) + length({_escaped("text", t)})) as bigint) as formatted_chars,
 regexp_full_match(string_agg(role || '/', '' order by turn nulls first, role, text), '(system/)?user/(assistant/user/)*(assistant/)?') as valid
from turns group by conv_id"""


def _quality() -> str:
    failed = " + ".join(f"case when {test(_Name)} then {1 << bit} else 0 end" for bit, (_, test) in enumerate(RULES))
    return f"""with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select *, regexp_extract_all(text, '{_WORD}') as ws from texts),
windows as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as w from (select r, ws, unnest(range(1, len(ws) - 1)) as i from words)),
twice as (select r, i from windows qualify count(*) over (partition by r, w) > 1),
covered as (select r, count(distinct i + k) as n from twice, (values (0), (1), (2)) as t(k) group by r),
lines as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(text, chr(10))) as line from texts) where regexp_matches(line, '{_WORD}') group by r),
m as (select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(lines.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
 from words left join lines using (r) left join covered using (r)),
f as (select *, cast({failed} as bigint) as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {mask("base")} <> 0 as base_failed, failed_bits & {mask("v1")} = 0 as kept, failed_bits from f"""


_JACCARD = f"""with recursive texts as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
shingles as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from texts where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)),
sides as (select a as x, b as y from links union select b, a from links),
reached as (select doc_id as id, doc_id as c from documents union select reached.id, sides.y from reached join sides on sides.x = reached.c)
select t.doc_id, coalesce(sizes.n, 0) as n_shingles, least_id.c as component_id
from texts t left join sizes using (doc_id) left join (select id, min(c) as c from reached group by id) least_id on least_id.id = t.doc_id"""

SQL = {"op1_chat_formatting": _chat(), "op4_quality_rules": _quality(), "op9_ngram_jaccard_join": _JACCARD}
