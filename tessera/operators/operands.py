"""Operands of binary instructions by a grammar: ids, enumerants and their parameters, strings, numbers of a type.

The grammar is a document with an instruction list (opcode and kinds of operands, with the quantifier
`?` or `*`) and a list of operand kinds: their category, the parameters of enumerants, the parts of
pairs. An operand whose width depends on a type gets it from the types of its own binary.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .programs import ID_BEGIN, ID_END, LITERAL_BEGIN, OP_FUNCTION, OP_LABEL, OPCODE_BEGIN, split_words

#: Fixed values of the binary format: opcodes that entry points, types, constants, switches and function ends have.
OP_ENTRY, OP_UNDEF, OP_INT, OP_FLOAT, OP_CONSTANT, OP_SPEC_CONSTANT, OP_VARIABLE, OP_PARAMETER, OP_FUNCTION_END, OP_SWITCH = 15, 1, 21, 22, 43, 50, 59, 55, 56, 251
#: Instructions of a grammar that one document may have, so that every task can hold it.
MOST_INSTRUCTIONS = 20_000
_DOCUMENT = """instructions array<struct<opcode: int, opname: string, class: string, operands: array<struct<kind: string, quantifier: string>>>>,
operand_kinds array<struct<category: string, kind: string, bases: array<string>, enumerants: array<struct<value: string, parameters: array<struct<kind: string>>>>>>"""


class Grammar(NamedTuple):
    """(kind, quantifier) of each opcode's operands; opcodes of types and constants; category, parts and enumerants' parameters of kinds.

    typed, results: opcodes with a literal number of a type, and those that begin with a result type and a result.
    """

    operands: dict[int, list[tuple[str, str]]]
    outside: frozenset[int]
    kinds: dict[str, tuple[str, list[str], dict[int, list[str]]]]
    typed: frozenset[int] = frozenset()
    results: frozenset[int] = frozenset()


def read_grammar(spark: SparkSession, path: str) -> Grammar:
    """A grammar from its documents. An opcode or kind that is there twice counts as its first by text; over MOST_INSTRUCTIONS are an error.
    """
    doc = spark.read.option("multiLine", True).schema(_DOCUMENT).json(path)
    rows = doc.select(F.explode("instructions").alias("i")).select("i.opcode", "i.operands", "i.class").limit(MOST_INSTRUCTIONS + 1).collect()
    if len(rows) > MOST_INSTRUCTIONS:
        raise ValueError("too many instructions for a grammar")
    kinds = doc.select(F.explode("operand_kinds").alias("k")).select("k.*").limit(MOST_INSTRUCTIONS).collect()
    number = lambda v: int(v, 16) if v.lower().startswith("0x") else int(v)
    out = Grammar({}, frozenset(r.opcode for r in rows if r["class"] in ("Type-Declaration", "Constant-Creation")), {})
    for r in sorted(rows, key=str):
        out.operands.setdefault(r.opcode, [(o.kind, o.quantifier or "") for o in r.operands or []])
    for k in sorted(kinds, key=str):
        out.kinds.setdefault(k.kind, (k.category, k.bases or [], {number(e.value): [p.kind for p in e.parameters or []] for e in k.enumerants or []}))
    typed = frozenset(o for o, kinds in out.operands.items() if any(k == "LiteralContextDependentNumber" for k, _ in kinds))
    return out._replace(typed=typed, results=frozenset(o for o, kinds in out.operands.items() if [k for k, _ in kinds[:2]] == ["IdResultType", "IdResult"]))


class _Reader:
    """The tokens of one instruction's operand words."""

    def __init__(self, grammar: Grammar, opcode: int, words: Sequence[int], sort: str | None, width: int | None):
        self.by_op, self.by_kind = grammar.operands, grammar.kinds
        self.opcode, self.words, self.sort, self.width = opcode, words, sort, width
        self.at, self.out = 0, []

    def read(self) -> list[int]:
        if self.opcode not in self.by_op:
            raise ValueError(f"opcode {self.opcode} is not in the grammar")
        self._all(self.by_op[self.opcode])
        if self.at < len(self.words):
            raise ValueError(f"opcode {self.opcode} has more words than its kinds")
        return self.out

    def _all(self, kinds: list[tuple[str, str]]) -> None:
        for kind, times in kinds:
            if times == "*":
                while self.at < len(self.words):
                    self._one(kind)
            elif not times or self.at < len(self.words):
                self._one(kind)

    def _word(self) -> int:
        if self.at >= len(self.words):
            raise ValueError(f"opcode {self.opcode} has fewer words than its kinds")
        self.at += 1
        return self.words[self.at - 1]

    def _text(self, text: str | bytes) -> None:
        self.out += [LITERAL_BEGIN + b for b in (text.encode() if isinstance(text, str) else text)]

    def _one(self, kind: str) -> None:
        category, bases, enumerants = self.by_kind.get(kind, ("Literal", [], {}))
        if category == "Id":
            n = self._word() + ID_BEGIN
            if n >= ID_END:
                raise ValueError(f"id {n - ID_BEGIN} is past the range")
            self.out.append(n)
        elif category == "Composite":
            for base in bases:
                self._one("LiteralContextDependentNumber" if self.opcode == OP_SWITCH and base == "LiteralInteger" else base)
        elif category in ("ValueEnum", "BitEnum"):
            n = self._word()
            self._text(str(n))
            for v in [n] if category == "ValueEnum" else [1 << i for i in range(32) if n >> i & 1]:
                for p in enumerants.get(v, ()):
                    self._one(p)
        elif kind == "LiteralString":
            data = b""
            while b"\0" not in data[-4:]:
                data += struct.pack("<I", self._word())
            self._text(data.split(b"\0")[0])
        elif kind == "LiteralContextDependentNumber":
            self._text(self._number())
        else:
            self._text(str(self._word()))
            if kind == "LiteralSpecConstantOpInteger":  # the operands of another instruction, without its result
                self._all([k for k in self.by_op.get(self.words[self.at - 1], []) if k[0] not in ("IdResultType", "IdResult")])

    def _number(self) -> str:
        if self.sort is None:
            raise ValueError("a number of no known type")
        data = struct.pack("<I", self._word()) + (struct.pack("<I", self._word()) if self.width > 32 else b"")
        if self.sort == "float":
            if self.width not in (32, 64):
                raise ValueError(f"a float of {self.width} bits")
            return f"{struct.unpack('<f' if self.width == 32 else '<d', data)[0]:.6f}"
        return str(int.from_bytes(data, "little", signed=self.sort == "signed"))


def _number_types(grammar: Grammar, insts: Sequence[tuple]) -> list[tuple[str | None, int | None]]:
    """(sort, width) of the type that each instruction's literal numbers follow, None where there is none.

    Instructions are (func_no, block, opcode, words) of one binary. A constant follows its result type,
    a switch the result type of what it selects by.
    """
    types, values, none = {}, {}, (None, None)
    for _, _, o, w in insts:
        if o in (OP_INT, OP_FLOAT) and len(w) > 1:
            types.setdefault(w[0], ("float" if o == OP_FLOAT else "signed" if w[2:3] == (1,) else "unsigned", w[1]))
        if o in grammar.results and len(w) > 1:
            values.setdefault(w[1], w[0])
    of = lambda o, w: w[0] if o in grammar.typed else values.get(w[0])
    return [types.get(of(o, w), none) if w and (o in grammar.typed or o == OP_SWITCH) else none for _, _, o, w in insts]


#: Instructions whose tokens a task keeps, as many are the same in many binaries.
MOST_SEEN = 100_000


def _tokens(grammar: Grammar, opcode: int, words: tuple[int, ...], number: tuple, seen: dict[tuple, list[int] | str]) -> list[int] | str:
    """An instruction's tokens, or what is wrong with it."""
    which = (opcode, words, number)
    found = seen.get(which)
    if found is None:
        try:
            found = [OPCODE_BEGIN + opcode, *_Reader(grammar, opcode, words, *number).read()]
        except ValueError as e:
            found = str(e)
        if len(seen) >= MOST_SEEN:
            seen.clear()
        if len(words) < 16:
            seen[which] = found
    return found


def _program(grammar: Grammar, data: bytes | None, seen: dict[tuple, list[int] | str]) -> tuple[list[int], list[int], list[int | None], str | None]:
    """The tokens of a binary, how many each of its instructions has, the block of each (None before any function), or what is wrong."""
    words, starts, damage = split_words(data)
    words, insts, entries, functions = tuple(words.tolist()), [], [], {}
    func, block = None, None
    for i in starts:
        o, w = words[i] & 0xFFFF, words[i + 1 : i + (words[i] >> 16)]
        if o == OP_FUNCTION:
            func, block = 0 if func is None else func + 1, None
            functions.setdefault(w[1] if len(w) > 1 else None, []).append(func)
        elif o == OP_LABEL:
            block = w[0] if w else None
        elif o == OP_ENTRY:
            entries.append(w[1] if len(w) > 1 else None)
        outside = func is None and (o in grammar.outside or o in (OP_VARIABLE, OP_UNDEF))
        if outside or block is not None and o not in (OP_PARAMETER, OP_FUNCTION_END):
            insts.append((func, block, o, w))
    tokens = [_tokens(grammar, o, w, number, seen) for (_, _, o, w), number in zip(insts, _number_types(grammar, insts), strict=True)]
    problems = [*([damage] if damage else []), *(t for t in tokens if isinstance(t, str))]
    main = [f for e in entries for f in (functions.get(e, [None]) if e is not None else [None])]
    if problems or len(main) != 1 or main[0] is None:
        return [], [], [], min(problems) if problems else "not one entry point" if len(main) != 1 else "the entry point is no function"
    section = lambda f: (0, 0) if f is None else (1, 0) if f == main[0] else (2, f)
    order = sorted(range(len(insts)), key=lambda i: section(insts[i][0]))  # stable: instructions stay in their order
    return [t for i in order for t in tokens[i]], [len(tokens[i]) for i in order], [None if insts[i][0] is None else insts[i][1] for i in order], None


#: Tokens after which a task passes on the binaries that it has read.
MOST_TOKENS = 1_000_000


def read_binaries(df: DataFrame, key: str, binary: str, grammar: Grammar, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (key, keep..., input_ids, sizes, blocks, problem): the tokens of each binary, and of its instructions their number and block.

    All that an instruction needs, the types of its numbers too, is in its own binary, so that nothing is
    shuffled. A block is null where the instruction is of no function. The arrays of a binary with a
    problem are empty.
    """
    names = [key, *keep, "input_ids", "sizes", "blocks", "problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, types = {}, [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]
        for b in batches:
            first, rows, n = 0, [], 0
            for at, data in enumerate(b.column(b.num_columns - 1), 1):
                rows.append(_program(grammar, data.as_py(), seen))
                n += len(rows[-1][0])
                if n >= MOST_TOKENS or at == b.num_rows:
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(rows)) for c in b.columns[:-1]), *columns], names=names)
                    first, rows, n = at, [], 0

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (key, *keep))
    return df.select(key, *keep, F.col(binary).cast("binary")).mapInArrow(run, kinds + "input_ids array<int>, sizes array<int>, blocks array<long>, problem string")


def tokenise_binaries(df: DataFrame, key: str, binary: str, grammar: Grammar, blocks: DataFrame | None = None) -> DataFrame:
    """Rows (key, input_ids, trace, problem): the tokens of a table of binaries, with the executions of their blocks.

    Types, constants and global variables come first, then the instructions of the blocks of the entry
    function and of the other functions in their order. `blocks` are rows (key, block_id, times), each
    block once; blocks that it lacks, and all without it, have 0. A binary that is damaged, has not just
    one entry point, or has an operand that the grammar cannot read has null arrays and one of its
    problems. Keys are taken as distinct.
    """
    rows = df.select(key, F.col(binary).alias("_binary"))
    if blocks is None:
        rows = rows.withColumn("_times", F.lit(None).cast("map<bigint,decimal(20,0)>"))
    else:
        one = F.struct(F.col("block_id").cast("long"), F.col("times").cast("decimal(20,0)"))
        rows = rows.join(blocks.where("block_id is not null").groupBy(key).agg(F.map_from_entries(F.collect_list(one)).alias("_times")), key, "left")
    rows = read_binaries(rows, key, "_binary", grammar, keep=["_times"])
    zero = F.lit(0).cast("decimal(20,0)")
    first = F.transform("blocks", lambda x: F.coalesce(F.try_element_at("_times", x), zero))
    trace = F.flatten(F.zip_with(first, "sizes", lambda t, n: F.concat(F.array(t), F.array_repeat(zero, n - 1))))
    good = F.col("problem").isNull()
    return rows.select(key, F.when(good, F.col("input_ids")).alias("input_ids"), F.when(good, trace).alias("trace"), "problem")
