"""Queries over syntax: every document becomes a source whose names are its own words.

The documents are prose, so an adapter writes four of their words at a time into statements of
one of nine languages, some of them broken, as many as the text is long. What the operators
find in them is worked out by SQL of its own, with its lists written out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import functions as F

from wayfind.catalog import register
from wayfind.operators import syntax as S
from wayfind.session import share_code, table

# Statements by language; a, b, c and d in braces are four words of the text.
STATEMENTS = {
    "rust": [
        "pub fn {a}({b}: {c}) -> {d} {\n    {b}.{c}({d}::new(1));\n}\n", "struct {a} {\n    {b}: {c},\n}\n// {d} (\n", "const {a}: &str = \"{b} ) {c}\";\nmod {d} { fn {b}() { {c}!(1) } }\n",
        "trait {a} { fn {b}(&self, [{c}]) }\nlet {d} = ({a});\n",
    ],
    "javascript": [
        "function {a}({b}) { return {c}.{d}({b}[0]); }\n", "class {a} {\n  {b}({c}) { {d}(`{a} { {b}`); }\n}\n", "const {a} = new {b}({c}, ({d}));\n", "if ({a}) { let {b} = '{c} (' + {d}; }\n",
    ],
    "typescript": [
        "interface {a} { {b}({c}): {d}; }\n", "type {a} = {b};\nenum {c} { {d} }\n", "export function {a}({b}: {c}) { return {d}({b}.{c}); }\n", "class {a} { {b}({c}) { /* ) */ {d}({a}); } }\n",
    ],
    "python": [
        "def {a}({b}, {c}):\n    return {d}({b}.{c})\n", "class {a}:\n    {b} = {c}({d})\n", "{a} = [{b}, {c}(\n    {d})]\n# {a} ( {b}\n", "{a}.{b}({c}={d})\nx = \"\"\"{a} (\n{b}\"\"\"\n",
    ],
    "ruby": [
        "def {a}({b})\n  {c}.{d}({b})\nend\n", "class {a}\n  {b} = {c}\n  def {d}\n    if {b}\n    end\n  end\nend\n", "module {a}\n  {b} '{c} (' do {d} end\nend\n", "{a} = {b} if {c}\n{d}\n",
    ],
    "java": [
        "class {a} {\n  private int {b} = {c}.{d}({b});\n}\n", "class {a} { public {b} {c}(int {d}) { return {d}.{a}(); } }\n", "interface {a} { void {b}({c} {d}); }\n", "package {a};\nenum {b} { {c}, {d} }\n",
    ],
    "c_sharp": [
        "namespace {a} { class {b} { public {c} {d}() { {a}(); } } }\n", "struct {a} { int {b}; {c} {d} = {b}; }\n", "class {a} { {b} {c}({d} x) { return new {b}({c}.{d}(x)); } }\n", "record {a};\n// {b} { {c} {d}\n",
    ],
    "go": [
        "func {a}({b} {c}) {d} { return {b}.{c}({d}(1)) }\n", "type {a} struct {\n  {b} {c}\n  {d} int\n}\n", "func (x {a}) {b}() { {c} := {d}(x) }\n", "const {a} = \"{b} }\"\nvar {c} {d}\n",
    ],
    "lua": [
        "function {a}({b}) return {c}.{d}({b}) end\n", "local {a} = {b}\nfunction {a}.{c}() if {d} then end end\n", "function {a}:{b}({c}) repeat {d}() until {c} end\n", "{a}.{b} = {c}\n{d} = {a} -- end (\n",
    ],
}


def _templates(language: str) -> list[dict[int, tuple[str, Callable]]]:
    """By a statement's place from 0, and by the length of its third word or 0: its text with %s for words, and which these are."""
    made = []
    for form in STATEMENTS[language]:
        order = [" abcd".index(x) - 1 for x in re.findall(r"\{([abcd])\}", form)]
        text = re.sub(r"\{[abcd]\}", "%s", form)
        said = {0: text, 7: text.replace(")", "]"), 9: text.replace("}", ""), 11: text + ")\n", 13: text + "'open\n"}
        made.append({size: (x, itemgetter(*order)) for size, x in said.items()})
    return made


def _sources(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text) as sources."""
    names, words, templates = list(STATEMENTS), re.compile("[A-Za-z]+").findall, [_templates(name) for name in STATEMENTS]
    for batch in batches:
        rows: list[tuple[str, str, str]] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key is None or key < 0:
                continue
            w, forms = words(text or ""), templates[key % len(names)]
            said = []
            for i in range(len(w) // 4):
                four = w[4 * i : 4 * i + 4]
                form = forms[i % 4]
                filled, order = form.get(len(four[2])) or form[0]
                said.append(filled % order(four))
            rows.append((str(key), names[key % len(names)], "".join(said)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["path", "language", "source"])


def sources(spark, d):
    """(path, language, source): every document's words in statements of the language that its id chooses.

    Dealt out as documents, which are shorter than their sources and read by few tasks.
    """
    share_code(spark)
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.repartition(S.parts(texts, "text"), "doc_id").mapInArrow(_sources, "path string, language string, source string")


def _sources_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    forms = ", ".join(f"({k}, '{lang}', [{', '.join(quoted(s) for s in v)}])" for k, (lang, v) in enumerate(STATEMENTS.items()))
    filled = "forms[(i % 4 + 1)::int]"
    for k, letter in enumerate("abcd"):
        filled = f"replace({filled}, '{{{letter}}}', w[4 * i + {k + 1}])"
    return rf"""
forms(k, language, forms) as (values {forms}),
words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') as w from documents),
statements as (select doc_id, i, language, len(w[4 * i + 3]) as size, {filled} as s from (select doc_id, w, unnest(range(len(w) // 4)) as i from words), forms where k = doc_id % 9),
sources as (select doc_id::varchar as path, any_value(language) as language, string_agg(case size when 7 then replace(s, ')', ']') when 9 then replace(s, '}}', '') when 11 then s || ')' || chr(10) when 13 then s || '''open' || chr(10) else s end, '' order by i) as source from statements group by doc_id)"""


def _lists(values: dict[str, str]) -> str:
    return ", ".join(f"('{lang}', '{w}')" for lang, words in values.items() for w in words.split())


# Fixed values, written out once more for the SQL: words that declare, with their kinds, and reserved words.
_DECLARING = """rust fn function, rust struct struct, rust enum enum, rust trait trait, rust type type, rust const const, rust static static, rust mod module,
 javascript function function, javascript class class, javascript const variable, javascript let variable, javascript var variable,
 typescript function function, typescript class class, typescript const variable, typescript let variable, typescript var variable, typescript interface interface, typescript type type, typescript enum enum,
 python def function, python class class, ruby def method, ruby class class, ruby module module,
 java package module, java class class, java record class, java interface interface, java enum enum,
 c_sharp namespace module, c_sharp class class, c_sharp record class, c_sharp struct struct, c_sharp interface interface, c_sharp enum enum,
 go package module, go func function, go type type, go const const, go var variable, lua function function, lua local variable"""
_RESERVED = {
    "rust": "fn struct enum trait type const static mod pub use impl let mut for in if else match return self super crate as ref move where while loop str",
    "javascript": "function class const let var new return if else for of in while do switch case import from export default this async await typeof extends static",
    "typescript": "function class const let var new return if else for of in while do switch case import from export default this async await typeof extends static interface type enum public private implements string number",
    "python": "def class return if else elif for in while import from as with try except pass and or not lambda None True False self",
    "ruby": "def class module end do if unless else elsif while until return self nil true false require begin case when then",
    "java": "package class record interface enum public private protected static final void int return new if else for while import this extends implements throws",
    "c_sharp": "namespace class record struct interface enum public private protected internal static void int return new if else for foreach while using this get set var",
    "go": "package func type const var struct interface return if else for range import map chan go defer int string",
    "lua": "function local end do if then else elseif for while repeat until return and or not nil true false in",
}
_KINDS = """rust identifier field field type identifier, javascript identifier field field identifier identifier, typescript identifier field field type identifier,
 python identifier identifier identifier identifier identifier, ruby identifier identifier identifier type identifier, java method method - type -, c_sharp method method - type -,
 go function method field type -, lua function function field identifier identifier"""


def _syntax_sql() -> str:
    rest = r"|::|:=|=>|->|[=!<>]=|[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|[ \t\r]+|\n|[\s\S]"
    slashes, double, single, back = r"//[^\n]*|/\*[^*]*(?:\*+[^*/][^*]*)*(?:\*+/)?", r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"?', r"''[^''\\\n]*(?:\\.[^''\\\n]*)*''?", r"`[^`]*`?"
    lexers = {
        "rust": rf"{slashes}|{double}|''(?:[^''\\\n]|\\.)''", "javascript": f"{slashes}|{double}|{single}|{back}", "typescript": f"{slashes}|{double}|{single}|{back}",
        "python": rf'#[^\n]*|"""[\s\S]*?(?:"""|\z)|{double}|{single}', "ruby": rf"#[^\n]*|{double}|{single}", "java": f"{slashes}|{double}|{single}", "c_sharp": f"{slashes}|{double}|{single}",
        "go": f"{slashes}|{double}|{single}|{back}", "lua": rf"--\[\[[\s\S]*?(?:\]\]|\z)|--[^\n]*|{double}|{single}",
    }
    split = " ".join(f"when '{lang}' then regexp_extract_all(source, '{p}{rest}')" for lang, p in lexers.items())
    triples = ", ".join("('" + "', '".join(x.split()) + "')" for x in _DECLARING.split(","))
    kinds = ", ".join("('" + "', '".join(x.split()) + "')" for x in _KINDS.split(","))

    def nest(source: str, name: str) -> str:
        return f"""
{name}1 as (select *, sum(case when o is not null then 1 when c is not null then -1 else 0 end) over w as total from {source} window w as (partition by path order by n)),
{name}2 as (select *, least(min(total) over w, 0) as low from {name}1 window w as (partition by path order by n)),
{name}3 as (select *, case when o is not null then total - low - 1 when c is not null and low < coalesce(lag(low) over w, 0) then 0 when c is not null then total - low + 1 else total - low end as level from {name}2 window w as (partition by path order by n)),
{name}4 as (select * exclude m, level + m as lv, m from (select *, unnest(case when o is null then [0] else [0, 1] end) as m from {name}3)),
{name} as materialized (select * exclude (m, lv, total, low) from (select *, max(case when m = 1 then n end) over (partition by path, lv order by n, m rows unbounded preceding) as around from {name}4) where m = 0)"""

    return rf"""with {_sources_sql()},
declaring(language, word, kind) as (values {triples}), reserved(language, word) as (values {_lists(_RESERVED)}), ref_kinds(language, call, member_call, member, capital, bare) as (values {kinds}),
pieces as (select path, language, unnest(p) as text, unnest(range(len(p))) as seq from (select path, language, case language {split} end as p from sources)),
placed as (select *, coalesce(sum(length(text)) over w, 0) as start, 1 + coalesce(sum(length(text) - length(replace(text, chr(10), ''))) over w, 0) as line from pieces window w as (partition by path order by seq rows between unbounded preceding and 1 preceding)),
known as (select *, case when (language in ('python', 'ruby') and text[1] = '#') or (language = 'lua' and text[1:2] = '--') or (language not in ('python', 'ruby', 'lua') and text[1:2] in ('//', '/*')) then 'comment'
  when text[1] in (' ', chr(9), chr(10), chr(13)) then 'space' when regexp_matches(text, '^[A-Za-z_$]') then 'word' when regexp_matches(text, '^[0-9]') then 'number'
  when text[1] in ('"', '`') or (text[1] = '''' and (length(text) > 1 or language <> 'rust')) then 'string' else 'mark' end as kind from placed),
toks as materialized (select path, language, text, kind, start, line, row_number() over w as n, coalesce(line > lag(line) over w, true) as first, lag(text) over w as b1, lag(text, 2) over w as b2, lag(text, 3) over w as b3, lead(text) over w as a1
  from known where kind not in ('space', 'comment') window w as (partition by path order by seq)),
opened as (select *, case when kind = 'word' and language = 'ruby' and (text in ('def', 'class', 'module', 'begin', 'case', 'do') or (first and text in ('if', 'unless', 'while', 'until'))) then 'end'
  when kind = 'word' and language = 'lua' and text in ('function', 'if', 'do') then 'end' when kind = 'word' and language = 'lua' and text = 'repeat' then 'until' when text = '(' then ')' when text = '[' then ']' when text = '{{' then '}}' end as o from toks),
marked as (select *, case when o is null and ((kind = 'word' and language in ('ruby', 'lua') and text = 'end') or (kind = 'word' and language = 'lua' and text = 'until') or text in (')', ']', '}}')) then text end as c from opened),
{nest("marked", "b")},
pairs as materialized (select p.path, p.n, p.around, p.level + 1 as depth, p.text, p.o, p.line, p.start, p.b1, p.b2, e.n as end_n, e.c as closed, e.a1 as follows from b p left join b e on e.path = p.path and e.c is not null and e.around = p.n where p.o is not null)"""


_SYNTAX = _syntax_sql()
_WORD = "t.kind = 'word' and not exists (select 1 from reserved r where r.language = t.language and r.word = t.text)"
_DECLARED = rf"""{_SYNTAX},
d0 as (select t.*, case when {_WORD} and not (t.language = 'rust' and t.b1 = 'const' and coalesce(t.a1, '') <> ':') then k.kind end as declares from b t left join declaring k on k.language = t.language and k.word = t.b1),
d1 as (select *, last_value(case when declares in ('class', 'struct', 'interface', 'enum', 'trait', 'type', 'module') then {{'owner': text, 'owner_kind': declares, 'ends': false}} when text in (';', '{{') then {{'owner': null, 'owner_kind': null, 'ends': true}} end ignore nulls) over (partition by path, around order by n rows between unbounded preceding and 1 preceding) as said from d0 where c is null),
heads as (select path, n, said.owner as owner, said.owner_kind as owner_kind from d1 where text = '{{'),
d2 as (select d0.*, h.owner, h.owner_kind, p.follows, g.path is not null as received, q.text as bracket,
    coalesce(regexp_matches(d0.b1, '^[A-Za-z_\]>]') and d0.b1 not in ('return', 'new', 'else'), false) as typed, coalesce(h.owner_kind in ('class', 'interface', 'struct', 'enum'), false) as body
  from d0 left join heads h on h.path = d0.path and h.n = d0.around left join pairs p on p.path = d0.path and p.n = d0.n + 1 and p.text = '(' left join pairs g on g.path = d0.path and g.end_n = d0.n - 1 and g.text = '(' and g.b1 = 'func' and d0.language = 'go'
  left join pairs q on q.path = d0.path and q.n = d0.around),
declared as materialized (select * from (select path, language, n, start, line, text as name, owner, case when received then 'method'
    when declares is not null then case when language = 'lua' and declares = 'function' and a1 in ('.', ':') then null else declares end
    when body and a1 = '(' and ((language in ('javascript', 'typescript') and follows in ('{{', ':')) or (language in ('java', 'c_sharp') and typed and follows in ('{{', ';'))) then 'method'
    when language = 'rust' and owner_kind = 'struct' and a1 = ':' then 'field' when language in ('java', 'c_sharp') and body and typed and a1 in ('=', ';') then 'field'
    when language = 'go' and owner_kind = 'type' and first and regexp_matches(a1, '^[A-Za-z_*\[]') then 'field' when language = 'go' and a1 = ':=' then 'variable'
    when language = 'lua' and b1 in ('.', ':') and a1 = '(' then case when b3 = 'function' then case b1 when '.' then 'function' else 'method' end end
    when language = 'lua' and b1 = '.' and a1 = '=' then 'field' when language in ('python', 'ruby', 'lua') and first and a1 = '=' and coalesce(bracket not in ('(', '['), true) then 'variable' end as kind from d2 t where {_WORD}) where kind is not null)"""


@register("syntax_nodes", f"{_SYNTAX} select path, count(*)::bigint as n_nodes, max(depth)::bigint as deepest, count(end_n)::bigint as n_closed, sum(n)::bigint as places, coalesce(sum(end_n), 0)::bigint as ends, coalesce(sum(around), 0)::bigint as parents from pairs group by path")
def syntax_nodes(spark, d):
    """Size, depth and spans of every source's tree."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = S.nodes(S.readable(sources(spark, d)), ("node", "parent", "depth", "end_n"))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").cast("long").alias("deepest"), F.count("end_n").alias("n_closed"), total("node").alias("places"), total("end_n").alias("ends"), total("parent").alias("parents"))


@register("syntax_errors", f"""{_SYNTAX} select path, line::bigint as line, start::bigint as start, 'unexpected ' || text as detail from b where c is not null and around is null
  union all select path, line, start, 'unclosed ' || text from pairs where end_n is null union all select path, line, start, 'closed otherwise: ' || text || ' ' || closed from pairs where o <> closed
  union all select path, line, start, 'deeper than 40' from pairs where depth = 41
  union all select path, line, start, 'unended text' from toks where kind = 'string' and not (case when text[1:3] = '\"\"\"' then length(text) >= 6 and text[-3:] = '\"\"\"' else length(text) > 1 and text[-1] = text[1] end)""")
def syntax_errors(spark, d):
    """Every error of every source, with a lower limit of depth than the engine's."""
    return S.errors(S.readable(sources(spark, d)), 40).select("path", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start"), "detail")


@register("syntax_declarations", f"{_DECLARED} select path, language, line::bigint as line, start::bigint as start, name, kind, owner from declared")
def syntax_declarations(spark, d):
    """Every declaration of every source, and what owns the block it is in."""
    return S.declarations(S.readable(sources(spark, d))).select("path", "language", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start"), "name", "kind", "owner")


def _references_sql() -> str:
    return rf"""{_DECLARED},
calls as (select p.*, case when p.text = '(' and regexp_matches(p.b1, '^[A-Za-z_$]') and not exists (select 1 from reserved r where r.language = b.language and r.word = p.b1)
    and not exists (select 1 from declaring k where k.language = b.language and k.word = p.b2) then 'call' when p.text not in ('(', '[') then 'block' end as says from pairs p join b on b.path = p.path and b.n = p.n),
again as (select b.* exclude (o, c, level, around), case when b.o is not null then k.says end as o, case when b.o is null then k.says end as c from b left join calls k on k.path = b.path and k.n = case when b.o is not null then b.n when b.c is not null then b.around end),
{_nest_again()},
refs as (select t.*, coalesce(k.says = 'call', false) as in_call, coalesce(t.b1 in ('.', '::') or (t.language = 'lua' and t.b1 = ':'), false) as of_member, coalesce(t.a1 = '(' or (t.language = 'rust' and t.a1 = '!'), false) as called
  from f t left join calls k on k.path = t.path and k.n = t.around where {_WORD} and not exists (select 1 from declared x where x.path = t.path and x.start = t.start)),
formed as (select r.*, nullif(case when regexp_matches(text, '^[A-Z]') and r.language in ('rust', 'typescript', 'ruby', 'java', 'c_sharp', 'go') and not of_member and (not called or coalesce(b1 = 'new', false)) then q.capital
  when called and of_member then q.member_call when called then q.call when of_member then q.member else q.bare end, '-') as ref from refs r join ref_kinds q on q.language = r.language)
select path, language, line::bigint as line, start::bigint as start, text as name, ref as kind,
  case when ref = 'type' then 'type_reference' when ref = 'method' or called or in_call then 'call' when ref = 'field' then 'member_reference' else 'bare_reference' end as evidence from formed where ref is not null"""


def _nest_again() -> str:
    """The nesting of calls and blocks, as of all brackets."""
    text = _SYNTAX[_SYNTAX.index("\nb1 as (") : _SYNTAX.index(",\npairs as")].strip()
    for k in "1234":
        text = text.replace(f"b{k} as (", f"f{k} as (").replace(f"from b{k}", f"from f{k}")
    return text.replace("b as materialized", "f as materialized").replace("from marked", "from again")


@register("syntax_references", _references_sql())
def syntax_references(spark, d):
    """Every reference of every source: words that no declaration spans, and what they are evidence of."""
    return S.references(S.readable(sources(spark, d))).select("path", "language", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start"), "name", "kind", "evidence")
