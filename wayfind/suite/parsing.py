"""Queries over the source parser: one for each language, and one over broken sources.

Every row of ``part`` gives a source file in the language, with names of its own; the SQL has
the symbols that stand in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.catalog import register
from wayfind.session import table

#: By language: the source, and its symbols as role, kind, name, scope, visibility, evidence
#: and line. ``@`` stands for the row's number.
SOURCES: dict[str, tuple[str, list[str]]] = {
    "rust": (
        'use std::fmt::Display as Shown;\nuse crate::{alpha, beta};\n\npub struct Part@ {\n    pub size: u32,\n}\n\nenum Color { Red }\ntrait Fits { fn fit(&self); }\ntype Id = u64;\nconst MAX: u32 = 7;\n'
        'static mut SEEN: u32 = 0;\nmod inner {\n    pub(crate) fn deep() {}\n}\nmacro_rules! twice { () => {} }\n\npub fn make@(x: u32) -> Part@ {\n    // fn not_this() {}\n    let s = "struct NorThis;";\n    helper(x.size, alpha)\n}\n',
        [
            "definition import Shown - unknown import 1", "definition import alpha - unknown import 2", "definition import beta - unknown import 2", "definition struct Part@ - public declaration 4",
            "definition field size Part@ public declaration 5", "definition enum Color - unknown declaration 8", "reference type Red Color unknown type_reference 8", "definition trait Fits - unknown declaration 9",
            "definition function fit Fits unknown declaration 9", "definition type Id - unknown declaration 10", "definition const MAX - unknown declaration 11", "definition static SEEN - unknown declaration 12",
            "definition module inner - unknown declaration 13", "definition function deep inner public declaration 14", "definition macro twice - unknown declaration 16", "definition function make@ - public declaration 18",
            "reference identifier x - unknown bare_reference 18", "reference type Part@ - unknown type_reference 18", "reference identifier s make@ unknown bare_reference 20", "reference identifier helper make@ unknown call 21",
            "reference identifier x make@ unknown call 21", "reference field size make@ unknown call 21", "reference identifier alpha make@ unknown call 21",
        ],
    ),
    "javascript": (
        "import dft, { one as uno } from './mod.js';\nexport class Box@ {\n  open(x) {\n    return this.lid.lift(x);\n  }\n}\nfunction* walk@(n) { yield n; }\nconst made = walk@(uno);\n",
        [
            "definition import dft - unknown import 1", "definition import one - unknown import 1", "definition import uno - unknown import 1", "definition class Box@ - public declaration 2",
            "definition method open Box@ unknown declaration 3", "reference identifier x Box@ unknown bare_reference 3", "reference identifier this Box@/open unknown bare_reference 4",
            "reference field lid Box@/open unknown member_reference 4", "reference field lift Box@/open unknown call 4", "reference identifier x Box@/open unknown call 4",
            "definition function walk@ - unknown declaration 7", "reference identifier n - unknown bare_reference 7", "reference identifier n walk@ unknown bare_reference 7",
            "definition variable made - unknown declaration 8", "reference identifier walk@ - unknown call 8", "reference identifier uno - unknown call 8",
        ],
    ),
    "javascript_jsx": (
        "export function View@(props) {\n  return <Box title={props.title} />;\n}\n",
        [
            "definition function View@ - public declaration 1", "reference identifier props - unknown bare_reference 1", "reference identifier Box View@ unknown bare_reference 2",
            "reference field title View@ unknown member_reference 2", "reference identifier props View@ unknown bare_reference 2", "reference field title View@ unknown member_reference 2",
        ],
    ),
    "typescript": (
        "import { Thing } from './thing';\nexport interface Shape@ { area: Size }\ntype Alias@ = Size | Thing;\nenum Kind@ { }\nclass Impl@ implements Shape@ {\n  private grow(by: Thing): void {\n    by.apply(1);\n  }\n}\n",
        [
            "definition import Thing - unknown import 1", "definition interface Shape@ - public declaration 2", "reference field area Shape@ unknown member_reference 2", "reference type Size Shape@ unknown type_reference 2",
            "definition type Alias@ - unknown declaration 3", "reference type Size - unknown type_reference 3", "reference type Thing - unknown type_reference 3", "definition enum Kind@ - unknown declaration 4",
            "definition class Impl@ - unknown declaration 5", "reference type Shape@ - unknown type_reference 5", "definition method grow Impl@ private declaration 6", "reference identifier by Impl@ unknown bare_reference 6",
            "reference type Thing Impl@ unknown type_reference 6", "reference identifier by Impl@/grow unknown bare_reference 7", "reference field apply Impl@/grow unknown call 7",
        ],
    ),
    "typescript_tsx": (
        "export const App@ = (p: Props) => <div>{p.name}</div>;\n",
        [
            "definition variable App@ - public declaration 1", "reference identifier p - unknown bare_reference 1", "reference type Props - unknown type_reference 1", "reference identifier div - unknown bare_reference 1",
            "reference identifier p - unknown bare_reference 1", "reference field name - unknown member_reference 1", "reference identifier div - unknown bare_reference 1",
        ],
    ),
    "python": (
        'import os.path\nfrom pkg import tool as t\n\nclass Part@:\n    kind = 1\n\n    def size(self, x):\n        return t(x.width)\n\nasync def run@():\n    """def no(): pass"""\n    await go@()\n',
        [
            "definition import os - unknown import 1", "definition import path - unknown import 1", "definition import t - unknown import 2", "definition class Part@ - unknown declaration 4",
            "definition variable kind Part@ unknown declaration 5", "definition function size Part@ unknown declaration 7", "reference identifier self Part@/size unknown bare_reference 7",
            "reference identifier x Part@/size unknown bare_reference 7", "reference identifier t Part@/size unknown call 8", "reference identifier x Part@/size unknown call 8",
            "reference identifier width Part@/size unknown call 8", "definition function run@ - unknown declaration 10", "reference identifier go@ run@ unknown call 12",
        ],
    ),
    "ruby": (
        "module Shop@\n  class Cart\n    def add(item)\n      total = item.price\n      Tax.apply(total)\n    end\n\n    def self.build\n    end\n  end\nend\n",
        [
            "definition module Shop@ - unknown declaration 1", "definition class Cart Shop@ unknown declaration 2", "definition method add Shop@/Cart unknown declaration 3",
            "reference identifier item Shop@/Cart/add unknown bare_reference 3", "definition variable total Shop@/Cart/add unknown declaration 4", "reference identifier item Shop@/Cart/add unknown bare_reference 4",
            "reference identifier price Shop@/Cart/add unknown bare_reference 4", "reference type Tax Shop@/Cart/add unknown type_reference 5", "reference identifier apply Shop@/Cart/add unknown call 5",
            "reference identifier total Shop@/Cart/add unknown call 5", "definition method build Shop@/Cart unknown declaration 8",
        ],
    ),
    "java": (
        "package com.shop;\nimport java.util.List;\n\npublic class Cart@ {\n    private int total;\n    public int add(Item item) {\n        return compute(item.price());\n    }\n}\ninterface Priced@ {}\nenum Size@ { }\n",
        [
            "definition module com.shop - unknown declaration 1", "definition import List - unknown import 2", "definition class Cart@ - public declaration 4", "definition field total Cart@ private declaration 5",
            "definition method add Cart@ public declaration 6", "reference type Item Cart@ unknown type_reference 6", "reference method compute Cart@/add unknown call 7", "reference method price Cart@/add unknown call 7",
            "definition interface Priced@ - unknown declaration 10", "definition enum Size@ - unknown declaration 11",
        ],
    ),
    "c_sharp": (
        "using System.Text;\nnamespace Shop {\n    public class Cart@ : Base {\n        private int total;\n        public int Count { get; set; }\n        internal void Add(Item item) {\n            store.Put(item);\n        }\n    }\n    struct Point@ {}\n    interface IPriced@ {}\n    enum Size@ { }\n}\n",
        [
            "definition import Text - unknown import 1", "definition module Shop - unknown declaration 2", "definition class Cart@ Shop public declaration 3", "reference type Base Shop unknown type_reference 3",
            "definition field total Shop/Cart@ private declaration 4", "definition field Count Shop/Cart@ public declaration 5", "definition method Add Shop/Cart@ internal declaration 6",
            "reference type Item Shop/Cart@ unknown type_reference 6", "reference method Put Shop/Cart@/Add unknown call 7", "definition struct Point@ Shop unknown declaration 10",
            "definition interface IPriced@ Shop unknown declaration 11", "definition enum Size@ Shop unknown declaration 12",
        ],
    ),
    "go": (
        'package shop\n\nimport (\n\t"fmt"\n\tn "net/http"\n)\n\nconst (\n\tMax = 7\n)\n\nvar seen int\n\ntype Cart@ struct {\n\tTotal int\n}\n\ntype Priced interface {\n\tPrice() int\n}\n\nfunc (c *Cart@) Add(x int) {\n\ty, err := n.Get(x)\n\tfmt.Println(y, err)\n}\n\nfunc build@() Cart@ {\n\treturn make@()\n}\n',
        [
            "definition module shop shop unknown declaration 1", "definition import fmt shop unknown import 4", "definition import n shop unknown import 5", "definition import net/http shop unknown import 5",
            "definition const Max shop public declaration 9", "definition variable seen shop internal declaration 12", "definition struct Cart@ shop public declaration 14", "definition field Total shop/Cart@ public declaration 15",
            "definition interface Priced shop public declaration 18", "definition method Price shop/Priced public declaration 19", "reference type Cart@ shop unknown type_reference 22",
            "definition method Add shop/Cart@ public declaration 22", "definition variable y shop/Add internal declaration 23", "definition variable err shop/Add internal declaration 23",
            "reference method Get shop/Add unknown call 23", "reference method Println shop/Add unknown call 24", "definition function build@ shop internal declaration 27", "reference type Cart@ shop unknown type_reference 27",
            "reference function make@ shop/build@ unknown call 28",
        ],
    ),
    "lua": (
        "local util = require('shop.util')\nlocal Cart = {}\nCart.size = 7\nfunction Cart.new(x)\n  return util.copy(x)\nend\nfunction Cart:add(item)\n  self.total = item\nend\nlocal function helper@()\nend\nglobal@ = function() end\n",
        [
            "definition variable util - internal declaration 1", "definition import shop.util - unknown import 1", "definition variable Cart - internal declaration 2", "reference identifier Cart - unknown bare_reference 3",
            "definition field size - public declaration 3", "reference identifier Cart - unknown bare_reference 4", "definition function new Cart public declaration 4", "reference identifier x new unknown bare_reference 4",
            "reference identifier util new unknown bare_reference 5", "reference function copy new unknown call 5", "reference identifier x new unknown call 5", "reference identifier Cart - unknown bare_reference 7",
            "definition method add Cart public declaration 7", "reference identifier item add unknown bare_reference 7", "reference identifier self add unknown bare_reference 8", "definition field total add unknown declaration 8",
            "reference identifier item add unknown bare_reference 8", "definition function helper@ - internal declaration 10", "definition function global@ - public declaration 12",
        ],
    ),
}


def _files(spark, d, language: str, source: str):
    k = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(k.alias("path"), F.lit(language).alias("language"), F.replace(F.lit(source), F.lit("@"), k).cast("binary").alias("content"))


def _sql(symbols: list[str]) -> str:
    names = ("role", "kind", "name", "scope", "visibility", "evidence", "line")
    rows = ", ".join("(" + ", ".join([str(n), *(f"'{x}'" for x in s.split(" "))]) + ")" for n, s in enumerate(symbols))
    filled = ", ".join(f"replace({c}, '@', p_partkey::varchar) as {c}" for c in names)
    return f"select path, seq, {filled.replace('replace(scope', 'replace(nullif(scope, chr(45))')} from (select p_partkey, p_partkey::varchar as path from part), (values {rows}) as s(seq, {', '.join(names)})"


def _query(language: str, source: str):
    def query(spark, d):
        from wayfind.sources.parser import parse_files

        found = parse_files(_files(spark, d, language, source))
        scope = F.array_join("scope", "/")
        return found.select("path", "seq", "role", "kind", "name", F.when(scope != "", scope).alias("scope"), "visibility", "evidence", F.col("location.start.line").cast("string").alias("line"))

    query.__doc__ = f"Every symbol of a {language} file for each part."
    return query


for _language, (_source, _symbols) in SOURCES.items():
    register(f"parse_{_language}", _sql(_symbols))(_query(_language, _source))


@register(
    "parse_findings",
    """select p_partkey::varchar || '.' || e as path, 'parse_error' as kind, line from part, (values ('rs', 2), ('py', 3)) as f(e, line) where p_partkey % 2 = 1""",
)
def parse_findings(spark, d):
    """Where the syntax of every second file breaks off."""
    from wayfind.sources import parser

    k, odd = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 1
    part = table(spark, d, "part")
    rust = part.select(F.concat(k, F.lit(".rs")).alias("path"), F.lit("rust").alias("language"), F.when(odd, "fn a() {}\nfn b() {\n").otherwise("fn a() {}\nfn b() {}\n").cast("binary").alias("content"))
    python = part.select(F.concat(k, F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.when(odd, "x = 1\n\ndef f(:\n").otherwise("def f(): pass\n").cast("binary").alias("content"))
    return parser.parse_findings(rust.unionAll(python)).select("path", "kind", "line")
