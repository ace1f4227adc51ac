"""Sources in each language, and the outlines that they must have; § stands for the doc_id."""

from __future__ import annotations

# extension -> (source, outline, entries as name:kind:first-last)
SAMPLES: dict[str, list[tuple[str, str, str]]] = {
    'go': [
        ('package a\n\nimport (\n\t"io"\n\tx "net/h§"\n)\n\ntype Box§ struct {\n\tn int\n}\n\nfunc (b *Box§) Put(\n\tw io.Writer,\n\tn int,\n) (int, error) {\n\treturn n, nil\n}\n', '# m.go [Go]\nimports: io, net/h§\n\nstruct Box§\n\nfunction (b *Box§) Put(w io.Writer, n int) -> (int, error)', 'Box§:struct:8-10, Put:method:12-17'),
        ('package a\n\nconst Limit§ = 3\n\nfunc Sum§(a, b int) int {\n\treturn a + b\n}\n', '# m.go [Go]\n\nconst (Limit§)\n\nfunction Sum§(a, b int) -> int', 'Sum§:function:5-7'),
    ],
    'rs': [
        ('use std::fmt;\n\n#[derive(Debug)]\npub struct Node§ {\n    id: u32,\n}\n\nimpl fmt::Display for Node§ {\n    fn fmt(\n        &self,\n        f: &mut fmt::Formatter,\n    ) -> fmt::Result {\n        write!(f, "{}", self.id)\n    }\n}\n', '# m.rs [Rust]\nimports: std::fmt\n\n#[derive(Debug)]\nstruct Node§\n\nimpl fmt::Display for Node§\n  - fmt(&self, f: &mut fmt::Formatter) -> fmt::Result', 'Node§:struct:4-6, Node§:impl:8-15, fmt:function:9-14'),
        ('pub trait Walk§ {\n    fn step(&mut self) -> bool;\n}\n\nfn go<T: Walk§>(w: T) -> u8 where T: Copy {\n    1\n}\n', '# m.rs [Rust]\n\ntrait Walk§\n  + step(&mut self) -> bool\n\nfunction go(w: T) -> u8', 'Walk§:trait:1-3, go:function:5-7'),
    ],
    'java': [
        ('package p;\n\nimport java.util.Map;\n\n@Deprecated\npublic class Shop§ {\n    private int n;\n\n    public Shop§(int n) {\n        this.n = n;\n    }\n\n    private Map<String, Integer> count(\n            String key,\n            final int... more) throws Exception {\n        return null;\n    }\n}\n', '# m.java [Java]\nimports: java.util.Map\n\n@Deprecated\nclass Shop§\n  + Shop§(n: int)\n  - count(key: String, more: int...) -> Map<String, Integer>', 'Shop§:class:5-18, Shop§:method:9-11, count:method:13-17'),
        ('public enum Kind§ {\n    A, B;\n\n    public boolean isA() {\n        return this == A;\n    }\n}\n', '# m.java [Java]\n\nenum Kind§\n  + isA() -> boolean', 'Kind§:enum:1-7, isA:method:4-6'),
    ],
    'c': [
        ('#include <math.h>\n#include "own§.h"\n\n/* int gone(void) { } */\nstatic double area§(const double *sides, int n)\n{\n    return sides[0] * n;\n}\n', '# m.c [C]\nimports: math.h, own§.h\n\nfunction area§(*sides: double, n: int) -> double', 'area§:function:5-8'),
        ('typedef enum {\n    RED,\n    BLUE\n} Colour§;\n\nstruct pair§ {\n    int a;\n};\n\nvoid swap(struct pair§ *p, char **names) {\n}\n', '# m.c [C]\n\ntypedef enum Colour§\n\nstruct pair§\n\nfunction swap(*p: pair§, **names: char) -> void', 'Colour§:typedef:1-4, pair§:struct:6-8, swap:function:10-11'),
    ],
    'cpp': [
        ('#include <map>\nnamespace n§ {\nstruct Point {\n    Point(int x, int y);\n    int norm() const { return 1; }\n};\n\nint Point::size(const std::map<int, int>& m) {\n    return 0;\n}\n}\n', '# m.cpp [C++]\nimports: map\n\nnamespace n§\n  struct Point\n    function norm() -> int\n\n\n  function Point::size(&m: std::map<int, int>) -> int', 'n§:namespace:2-11, Point:struct:3-6, Point::size:function:8-10'),
        ('template <class T>\nT twice§(T a) {\n    return a + a;\n}\n', '# m.cpp [C++]\n\ntemplate <class T>\nfunction twice§(a: T) -> T', 'twice§:function:2-4'),
    ],
    'cs': [
        ('using System.Text;\n\nnamespace A.B;\n\npublic class Cart§\n{\n    public int Total => 3;\n    private void Add(string s) { }\n}\n', '# m.cs [C#]\nimports: System.Text\n\nclass Cart§\n  + Total: int\n  - Add() -> void', 'Cart§:class:5-9, Add:method:8-8'),
        ('namespace X\n{\n    public interface IThing§\n    {\n        int Size { get; }\n        bool Has(int k);\n    }\n}\n', '# m.cs [C#]\n\ninterface IThing§\n  + Size: int\n  + Has() -> bool', 'IThing§:interface:3-7, Has:method:6-6'),
    ],
    'kt': [
        ('import a.b\n\nsealed class Result§\n\nfun <T> List<T>.second§(\n    from: Int = 0,\n): T = this[1]\n', '# m.kt [Kotlin]\nimports: a.b\n\nsealed class Result§\n\nfunction second§(from: Int = 0) -> T', 'Result§:class:3-3, second§:function:5-7'),
        ('class Repo§(val db: String) {\n    private fun open(): Int {\n        return 1\n    }\n\n    val size: Int\n        get() = 2\n}\n', '# m.kt [Kotlin]\n\nclass Repo§\n  - open() -> Int\n  + size', 'Repo§:class:1-8, open:method:2-4'),
    ],
    'rb': [
        ('require "set"\n\nclass Queue§\n  attr_accessor :head, :tail\n\n  def push(x, *rest)\n    if x\n      1\n    end\n  end\n\n  def size = 3\nend\n', '# m.rb [Ruby]\nimports: set\n\nclass Queue§\n  attr_accessor head, tail\n  + push(x, *rest)\n  + size()', 'Queue§:class:3-13, head:property:4-4, tail:property:4-4, push:method:6-10, size:method:12-12'),
        ('module Tools§\n  def self.run(a, b: 2)\n    [1].each do |i|\n      i\n    end\n  end\nend\n', '# m.rb [Ruby]\n\nmodule Tools§\n  + self.run(a, b: 2)', 'Tools§:class:1-7, run:method:2-6'),
    ],
    'php': [
        ('<?php\nuse A\\B;\n\nabstract class Base§ {\n    protected ?int $id = null;\n\n    abstract public function name(): string;\n\n    private static function make(array $rows, int ...$more): ?self {\n        return null;\n    }\n}\n', '# m.php [PHP]\nimports: A\\B\n\nclass Base§\n  - $id\n  + name() -> string\n  - make($rows: array, ...$more: int) -> ?self', 'Base§:class:4-12, name:method:7-7, make:method:9-11'),
        ('<?php\nfunction total§(float $a, float $b = 0.5): float\n{\n    return $a + $b;\n}\n', '# m.php [PHP]\n\nfunction total§($a: float, $b: float) -> float', 'total§:function:2-5'),
    ],
    'lua': [
        ('local util = require("util§")\n\nlocal M = {}\n\nfunction M.open(path, mode)\n  if path then\n    return 1\n  end\nend\n\nlocal function close§()\nend\n', '# m.lua [Lua]\nimports: util§\n\n+ M.open(path, mode)\n+ close§() [local]', 'M.open:function:5-9, close§:function:11-12'),
        ('M.run§ = function(a)\n  for i = 1, 3 do\n    a(function() return i end)\n  end\nend\n', '# m.lua [Lua]\n\n+ M.run§(a)', 'M.run§:function:1-5'),
    ],
    'swift': [
        ('import Foundation\n\nprotocol Shape§ {\n    func area() -> Double\n}\n\nstruct Disc§: Shape§ {\n    let r: Double\n    private func hidden(\n        _ x: Int,\n        y: Int\n    ) -> Int {\n        return x\n    }\n}\n', '# m.swift [Swift]\nimports: Foundation\n\nprotocol Shape§\n\nstruct Disc§\n  + r: Double\n  - hidden() -> Int', 'Shape§:protocol:3-5, Disc§:struct:7-15, hidden:method:9-14'),
        ('extension String {\n    func shout§() -> String {\n        return uppercased()\n    }\n}\n', '# m.swift [Swift]\n\nextension String\n  + shout§() -> String', 'String:class:1-5, shout§:method:2-4'),
    ],
    'scala': [
        ('import a.b.C\n\ntrait Store[T] {\n  def get(k: String): Option[T]\n  def all(): List[T] = Nil\n}\n', '# m.scala [Scala]\nimports: a.b.C\n\ntrait Store\n  function all() -> List[T]', 'Store:trait:3-6, get:function:4-4, all:function:5-5'),
        ('object Main§ {\n  val n = 3\n  private def run(a: Int)(b: Int): Unit = {\n    println(a)\n  }\n}\n', '# m.scala [Scala]\n\nobject Main§\n  val n\n  function run(a: Int)', 'Main§:object:1-6, n:property:2-2, run:function:3-5'),
    ],
    'zig': [
        ('const std = @import("std");\n\npub const Pair§ = struct {\n    a: u8,\n    b: u8 = 2,\n\n    fn sum(self: Pair§) u8 {\n        return self.a + self.b;\n    }\n};\n', '# m.zig [Zig]\nimports: std\n\npub struct Pair§\n  a: u8\n  b: u8\n  - sum(self: Pair§) -> u8', 'Pair§:struct:3-10, sum:method:7-9'),
        ('const Mode§ = enum { on, off };\n\npub fn run§(\n    n: usize,\n) !void {\n    _ = n;\n}\n', '# m.zig [Zig]\n\nenum Mode§\n  variants: on, off\n\npub function run§(n: usize) -> !void', 'Mode§:enum:1-1, run§:function:3-7'),
    ],
    'ex': [
        ('defmodule Cache§ do\n  use Agent\n  alias Foo.Bar\n\n  defstruct name: nil, size: 0\n\n  def put(k, v \\\\ nil) do\n    case k do\n      1 -> v\n    end\n  end\n\n  defp secret, do: 1\nend\n', '# m.ex [Elixir]\nimports: use Agent, alias Foo.Bar\n\ndefmodule Cache§\n  defstruct [name, size]\n  def put(k, v \\\\ nil)\n  defp secret()', 'Cache§:class:1-14, put:function:7-11, secret:function:13-13'),
        ('defprotocol Size§ do\n  def size(x)\nend\n', '# m.ex [Elixir]\n\ndefprotocol Size§\n  def size(x)', 'Size§:interface:1-3, size:function:2-2'),
    ],
    'ts': [
        ('import {\n  a,\n  b§,\n} from "./lib";\n\nexport abstract class View§ extends Base {\n  static count = 0;\n  private async load(\n    url: string,\n  ): Promise<void> {\n  }\n}\n', '# m.ts [TypeScript]\nimports: ./lib\n\nclass View§\n  + count()\n  - load(url: string) -> Promise<void>', 'View§:class:6-12, load:method:8-11'),
        ('export const pick§ = <T>(xs: T[], n = 1): T => xs[n];\n\ninterface Opts§ {\n  readonly deep?: boolean;\n  run(x: number): void;\n}\n\ntype Id§ = {\n  a: string;\n};\n', '# m.ts [TypeScript]\n\nfunction pick§(xs: T[], n = 1) -> T\n\ninterface Opts§\n  + deep?: boolean\n  + run(x: number) -> void\n\ntype Id§ = { a: string; }', 'pick§:function:1-1, Opts§:interface:3-6, Id§:type:8-10'),
    ],
    'js': [
        ('import x from "./x§.js";\n\nclass A§ {\n  #secret = 1;\n  get size() {\n    return 2;\n  }\n}\n', '# m.js [JavaScript]\nimports: ./x§.js\n\nclass A§\n  - #secret()\n  + size()', 'A§:class:3-8, size:method:5-7'),
        ('export default async function main§(a, { b }) {\n}\n\nconst go§ = async (n) => {\n};\n', '# m.js [JavaScript]\n\nfunction main§(a, { b })\n\nfunction go§(n)', 'main§:function:1-2, go§:function:4-5'),
    ],
}
