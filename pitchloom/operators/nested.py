"""Deeply nested records to linked flat rows by vectorised structural indexing.

JSON text is never walked record by record. A block of payloads is one byte buffer over
which quote, escape, bracket and delimiter bitmaps are built; prefix sums of the quote
bitmap tell text from structure and prefix sums of the bracket bitmap give the nesting
depth. Sorting the structural tokens by depth puts the members of each container next to
each other, which both proves the grammar and yields the spans of child records. Typed
array columns need no text index: Arrow's list offsets are those prefix sums already.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA, STRING, SCALAR, START = range(9)
_TOKEN_OF_BYTE = np.full(256, -1, np.int8)
for _byte, _kind in zip(b"{}[]:,", range(6)):
    _TOKEN_OF_BYTE[_byte] = _kind
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
_WORDS = {b"true", b"false", b"null"}
_ESCAPED_TEXT = re.compile(rb'(?:[^\\"]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*\Z', re.S)


@dataclass(frozen=True)
class RecordSpec:
    """A kind of child record.

    kind: label of the emitted rows. keys: names under which senders deliver the records.
    id_keys: names of the record's own id. parent: kind whose object must hold ``keys``;
    None links the record to the delivered row and accepts the key under any wrapper.
    """

    kind: str
    keys: tuple[str, ...]
    id_keys: tuple[str, ...]
    parent: str | None = None


class StructuralIndex:
    """Token table of a block of JSON payloads (see the module docstring)."""

    def __init__(self, payloads: list[bytes]) -> None:
        lengths = np.fromiter((len(p) for p in payloads), np.int64, len(payloads))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.ends = self.starts + lengths
        self.buf = buf = np.frombuffer(b"\n".join(payloads) + b"\n", np.uint8)
        self.raw = buf.tobytes()
        n = len(buf)
        place = np.arange(n, dtype=np.int64)
        of = np.zeros(n, np.int32)
        of[self.starts[1:]] = 1
        of = np.cumsum(of, dtype=np.int32)

        slash = buf == 92
        self.slashes = np.cumsum(slash, dtype=np.int64)  # up to and with each byte
        run = place - np.maximum.accumulate(np.where(slash, -1, place))
        escaped = np.zeros(n, bool)
        escaped[1:] = (run[:-1] & 1).astype(bool)
        quote = (buf == 34) & ~escaped
        quotes = np.cumsum(quote, dtype=np.int32)
        base = np.where(self.starts > 0, quotes[self.starts - 1], 0)
        inside = ((quotes - base[of]) & 1).astype(bool)  # an opening quote counts as inside, a closing one not
        opening_quote = quote & inside
        outside = ~inside & ~quote

        kind = np.where(outside, _TOKEN_OF_BYTE[buf], -1)
        opening = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY)
        closing = (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)
        depth = np.cumsum(opening.astype(np.int32) - closing.astype(np.int32), dtype=np.int32)
        depth_base = np.where(self.starts > 0, depth[self.starts - 1], 0)
        depth = depth - depth_base[of]
        body = outside & (kind < 0) & ~_SPACE[buf]
        scalar_start = body.copy()
        scalar_start[1:] &= ~body[:-1]

        valid = lengths > 0
        last = self.ends  # the separator after each payload
        valid &= ~inside[last] & (depth[last] == 0)
        valid[of[depth < 0]] = False
        valid[of[inside & (buf < 32)]] = False

        at = np.flatnonzero((kind >= 0) | opening_quote | scalar_start)
        self.pos, self.of = at, of[at]
        self.kind = np.where(kind[at] >= 0, kind[at], np.where(opening_quote[at], STRING, SCALAR)).astype(np.int8)
        # A token lies in the container that is open around it; brackets lie in their parent.
        # A payload that closes more than it opens is invalid; its tokens must not sort before its start marker.
        self.level = np.maximum(depth[at] - opening[at], 0)
        closers = np.flatnonzero(quote & ~inside)
        self.end = at + 1
        is_string = self.kind == STRING
        if is_string.any():
            where = np.searchsorted(closers, at[is_string])
            self.end[is_string] = np.where(where < len(closers), closers[np.minimum(where, max(len(closers) - 1, 0))], n) if len(closers) else n
        is_scalar = self.kind == SCALAR
        stops = np.flatnonzero(~body)
        if is_scalar.any():
            self.end[is_scalar] = stops[np.searchsorted(stops, at[is_scalar])]
        self._order()
        self.valid = self._check(valid, slash)

    def _order(self) -> None:
        """Sort by payload, level and place; a start marker opens each container."""
        n, roots = len(self.pos), len(self.starts)
        openers = np.flatnonzero((self.kind == OPEN_OBJECT) | (self.kind == OPEN_ARRAY))
        token = np.concatenate([np.full(roots, -1), openers, np.arange(n)])
        payload = np.concatenate([np.arange(roots), self.of[openers], self.of])
        level = np.concatenate([np.zeros(roots, np.int64), self.level[openers] + 1, self.level])
        place = np.concatenate([self.starts - 1, self.pos[openers], self.pos])
        marker = np.concatenate([np.ones(roots + len(openers), bool), np.zeros(n, bool)])
        order = np.lexsort((~marker, place, level, payload))
        self.s_token, self.s_marker, self.s_of = token[order], marker[order], payload[order]
        opened = np.maximum.accumulate(np.where(self.s_marker, np.arange(len(order)), -1))
        self.s_container = self.s_token[opened]  # token of the opening bracket; -1: the payload itself
        self.s_kind = np.where(self.s_marker, START, self.kind[np.maximum(self.s_token, 0)] if n else START)

    def _check(self, valid: np.ndarray, slash: np.ndarray) -> np.ndarray:
        if not len(self.pos):
            return np.zeros(len(valid), bool)
        kind, container = self.s_kind, self.s_container
        before = np.roll(kind, 1)
        after = np.roll(kind, -1)
        after[-1] = START
        two_before = np.roll(kind, 2)
        first = self.s_marker
        in_object = (container >= 0) & (self.kind[np.maximum(container, 0)] == OPEN_OBJECT)
        in_array = (container >= 0) & ~in_object
        in_root = container < 0
        starts_value = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY) | (kind == STRING) | (kind == SCALAR)
        ends_value = (before == CLOSE_OBJECT) | (before == CLOSE_ARRAY) | (before == STRING) | (before == SCALAR)
        pair = ((before == OPEN_OBJECT) & (kind == CLOSE_OBJECT)) | ((before == OPEN_ARRAY) & (kind == CLOSE_ARRAY))
        key = (before == STRING) & ((two_before == START) | (two_before == COMMA))
        fine = pair | ((before == START) & starts_value & ~in_object) | ((before == COMMA) & starts_value & in_array)
        fine |= ends_value & (kind == COMMA) & in_array
        fine |= in_object & (((before == START) | (before == COMMA)) & (kind == STRING))
        fine |= in_object & key & (kind == COLON)
        fine |= in_object & (before == COLON) & starts_value
        fine |= in_object & ends_value & ~key & (kind == COMMA)
        fine |= first
        # Where a container ends: nothing may be left half said.
        closes = after == START
        done = (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY) | (kind == STRING) | (kind == SCALAR)
        is_key = (kind == STRING) & ((before == START) | (before == COMMA)) & in_object
        good_end = (done & ~is_key) | (first & ~in_root)
        fine &= ~closes | good_end
        valid[self.s_of[~fine]] = False

        scalars = np.flatnonzero(self.kind == SCALAR)
        digits = np.cumsum((self.buf >= 48) & (self.buf <= 57), dtype=np.int64)
        begin, end = self.pos[scalars], self.end[scalars]
        plain = (digits[end - 1] - digits[begin] + ((self.buf[begin] >= 48) & (self.buf[begin] <= 57)) == end - begin) & ((end - begin == 1) | (self.buf[begin] != 48))
        for t in scalars[~plain]:
            text = self.raw[self.pos[t] : self.end[t]]
            if text not in _WORDS and not _NUMBER.match(text):
                valid[self.of[t]] = False
        if slash.any():
            slashes = self.slashes
            strings = np.flatnonzero(self.kind == STRING)
            ends = np.minimum(self.end[strings], len(self.buf) - 1)
            for t in strings[slashes[ends] > slashes[self.pos[strings]]]:
                if not _ESCAPED_TEXT.match(self.raw[self.pos[t] + 1 : self.end[t]]):
                    valid[self.of[t]] = False
            valid[self.of_byte(np.flatnonzero(slash & ~self._in_string_bytes()))] = False
        return valid

    def _in_string_bytes(self) -> np.ndarray:
        cover = np.zeros(len(self.buf) + 1, np.int32)
        strings = self.kind == STRING
        np.add.at(cover, self.pos[strings], 1)
        np.add.at(cover, np.minimum(self.end[strings], len(self.buf)), -1)
        return np.cumsum(cover)[:-1] > 0

    def of_byte(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def text(self, token: int) -> str:
        """The token's text; strings without their quotes and with escapes resolved."""
        if self.kind[token] == STRING:
            raw = self.raw[self.pos[token] : self.end[token] + 1]
            # lone surrogates, escaped or not, stay as they are
            return json.loads(raw.decode("utf-8", "surrogatepass")) if b"\\" in raw else raw[1:-1].decode("utf-8", "surrogatepass")
        return self.raw[self.pos[token] : self.end[token]].decode("utf-8", "surrogatepass")

    def whole(self, token: int) -> int | None:
        """The whole number that a text or scalar token writes."""
        raw = self.raw[self.pos[token] : self.end[token]]
        return int(raw) if len(raw) < 19 and raw.isdigit() else whole_number(self.text(token))

    def members(self, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(token of the object, token of the value) for every member under one of the names."""
        spot = np.flatnonzero((self.s_kind == COLON) & self.valid[self.s_of])
        keys = self.s_token[spot - 1]
        begin, length = self.pos[keys] + 1, self.end[keys] - self.pos[keys] - 1
        hit = np.zeros(len(spot), bool)
        for name in names:
            want = np.frombuffer(name.encode(), np.uint8)
            same = np.flatnonzero(length == len(want))
            if len(same):
                hit[same] |= (self.buf[begin[same][:, None] + np.arange(len(want))] == want).all(axis=1)
        # a name may be written with escapes, which only lengthen it
        longer = np.flatnonzero((length > min(len(n) for n in names)) & (self.slashes[begin + length] > self.slashes[begin - 1]))
        for k in longer:
            hit[k] |= self.text(keys[k]) in names
        spot = spot[hit]
        return self.s_container[spot], self.s_token[spot + 1]

    def objects(self, value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objects that the values hold: an object itself, or the objects of an array (arrays
        of arrays are opened too). Returns (object token, owner, place among its siblings)."""
        kinds = self.kind[value]
        single = kinds == OPEN_OBJECT
        got, of, rank = [value[single]], [owner[single]], [np.zeros(single.sum(), np.int64)]
        arrays, owners = value[kinds == OPEN_ARRAY], owner[kinds == OPEN_ARRAY]
        while len(arrays):
            inner = np.flatnonzero(~self.s_marker & ((self.s_kind == OPEN_OBJECT) | (self.s_kind == OPEN_ARRAY)))
            sort = np.argsort(arrays)
            at = np.searchsorted(arrays[sort], self.s_container[inner])
            at = np.minimum(at, len(arrays) - 1)
            hit = arrays[sort][at] == self.s_container[inner]
            inner, of_array = inner[hit], sort[at[hit]]
            is_object = self.s_kind[inner] == OPEN_OBJECT
            members = self.s_token[inner[is_object]]
            first = np.concatenate(([True], of_array[is_object][1:] != of_array[is_object][:-1])) if is_object.any() else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.zeros(0, np.int64)
            got.append(members)
            of.append(owners[of_array[is_object]])
            rank.append(np.arange(len(first)) - start)
            arrays, owners = self.s_token[inner[~is_object]], owners[of_array[~is_object]]
        return np.concatenate(got), np.concatenate(of), np.concatenate(rank)

    def closing(self, opener: np.ndarray) -> np.ndarray:
        """Byte after the bracket that closes each opener."""
        spot = np.flatnonzero(~self.s_marker & ((self.s_kind == OPEN_OBJECT) | (self.s_kind == OPEN_ARRAY)))
        after = dict(zip(self.s_token[spot].tolist(), self.s_token[np.minimum(spot + 1, len(self.s_token) - 1)].tolist()))
        return np.fromiter((self.pos[after[o]] + 1 for o in opener.tolist()), np.int64, len(opener))


#: A whole number however it was typed: sign, leading zeros, a fraction of zeros.
_WHOLE = re.compile(r"([+-]?)0*([0-9]{1,19})(?:\.0*)?\Z")
_WHOLE_SQL = r"^[+-]?0*[0-9]{1,19}(\.0*)?$"
LEAST_ID, MOST_ID = -(1 << 63), (1 << 63) - 1


def whole_number(text: str) -> int | None:
    """An id however it was typed: 7, "7", 7.0, " 07 ", 7e0; None for anything that isn't a whole
    number of 64 bits. Exponents are read as JSON numbers are, within the exact range of doubles."""
    text = text.strip()
    if found := _WHOLE.match(text):
        value = int(found[1] + found[2])
    else:
        if not _NUMBER.match(text.encode("utf-8", "replace")):
            return None
        number = float(text)
        if abs(number) >= 2**53 or number != int(number):
            return None
        value = int(number)
    return value if LEAST_ID <= value <= MOST_ID else None


def _last_of_each(holder: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Holders in ascending order and the last value each of them has."""
    order = np.argsort(holder, kind="stable")
    holder, value = holder[order], value[order]
    last = np.append(holder[1:] != holder[:-1], True)[: len(holder)]
    return holder[last], value[last]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the wanted ones, whether they are there), from ascending keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


def extract(payloads: list[bytes], specs: tuple[RecordSpec, ...], with_record: bool) -> dict[str, list]:
    """Rows of the linked tables for a block of payloads; ``row`` is the payload's place."""
    out: dict[str, list] = {"row": [], "record_kind": [], "parent": [], "child": [], "ordinal": [], "record": []}
    rows = list(range(len(payloads)))
    while rows:  # a payload may be JSON text inside a JSON string; each wrapping is shorter than the last
        index = StructuralIndex(payloads)
        place = np.asarray(rows)
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # kind: its objects, ascending, and their ids
        for spec in specs:
            holder, value = index.members(spec.keys)
            up = None
            if spec.parent is not None:
                up, is_known = _look_up(*known[spec.parent], holder)
                holder, value, up = holder[is_known], value[is_known], up[is_known]
            number = np.arange(len(holder))
            record, owner, rank = index.objects(value, number)
            token, has_id = _look_up(*_last_of_each(*index.members(spec.id_keys)), record)
            has_id &= np.isin(index.kind[token], (STRING, SCALAR))
            child = [index.whole(t) for t in token[has_id].tolist()]
            fine = np.flatnonzero(has_id)[[c is not None for c in child]] if child else np.zeros(0, np.int64)
            child = np.array([c for c in child if c is not None], np.int64)
            record, owner, rank = record[fine], owner[fine], rank[fine]
            order = np.argsort(record)
            known[spec.kind] = record[order], child[order]
            out["row"] += place[index.of[record]].tolist()
            out["record_kind"] += [spec.kind] * len(record)
            out["parent"] += [None] * len(record) if up is None else up[owner].tolist()
            out["child"] += child.tolist()
            out["ordinal"] += rank.tolist()
            if with_record:
                out["record"] += [index.raw[a:b].decode("utf-8", "replace") for a, b in zip(index.pos[record].tolist(), index.closing(record).tolist())]
            else:
                out["record"] += [None] * len(record)
        whole = (index.s_kind == STRING) & (index.s_container < 0) & index.valid[index.s_of]
        texts = [(rows[index.s_of[k]], index.text(index.s_token[k])) for k in np.flatnonzero(whole)]
        rows, payloads = [r for r, _ in texts], [t.encode("utf-8", "surrogatepass") for _, t in texts]
        # a payload is never longer inside than outside, so an empty one ends its chain
        rows, payloads = [r for r, t in zip(rows, payloads) if t], [t for t in payloads if t]
    return out


def _blocks(values: list[bytes | None], limit: int) -> Iterator[tuple[list[int], list[bytes]]]:
    places: list[int] = []
    block: list[bytes] = []
    size = 0
    for k, value in enumerate(values):
        if not value:
            continue
        if block and size + len(value) > limit:
            yield places, block
            places, block, size = [], [], 0
        places.append(k)
        block.append(value)
        size += len(value) + 1
    if block:
        yield places, block


def flatten_json(df: DataFrame, id_col: str, payload_col: str, specs: list[RecordSpec], with_record: bool = False, block_bytes: int = 1 << 20) -> DataFrame:
    """Child records of JSON payloads as rows (row_id, record_kind, parent_id, child_id, ordinal[, record]).

    ``row_id`` is ``id_col``; ``parent_id`` is the id of the parent record, or ``id_col``
    for kinds without a parent; ``ordinal`` is the place in the delivered array; ``record``
    the child's own JSON text. Specs must come parents first.

    Null, empty or invalid payloads give no rows; neither do null elements, elements that
    aren't objects, and records without a whole-number id (nor their children, which
    would have nothing to link to). A null ``id_col`` is kept as a null parent. Repeated
    deliveries give repeated rows. Other columns of ``df`` are ignored, whatever their
    names. Blocks of at most ``block_bytes`` (or one payload) are indexed at a time.
    """
    specs_ = tuple(specs)
    fields = [("row_id", pa.int64()), ("record_kind", pa.string()), ("parent_id", pa.int64()), ("child_id", pa.int64()), ("ordinal", pa.int32())]
    fields += [("record", pa.string())] * with_record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            values = batch.column(1).cast(pa.large_binary()).to_pylist()
            for places, block in _blocks(values, block_bytes):
                got = extract(block, specs_, with_record)
                row = [ids[places[k]] for k in got["row"]]
                columns = [row, got["record_kind"], [r if p is None else p for r, p in zip(row, got["parent"])], got["child"], got["ordinal"], got["record"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    schema = "row_id long, record_kind string, parent_id long, child_id long, ordinal int" + ", record string" * with_record
    return df.select(F.col(id_col).cast("long"), F.col(payload_col).cast("string")).mapInArrow(run, schema)


def flatten_lists(df: DataFrame, id_col: str, lists: dict[str, str], item_key: str, carry: tuple[str, ...] = (), values: tuple[str, ...] = ()) -> DataFrame:
    """Elements of typed array columns as rows (record_kind, parent_id, child_id, ordinal, *carry, *values).

    ``lists`` maps the label of the rows to an array<struct> column. Spans come from the
    list offsets of the Arrow arrays; the parent's id and the ``carry`` columns (kept at
    the parent, e.g. the period of a frame) are repeated over each span. ``child_id`` is
    ``item_key`` read as a whole number ("7", "07", " 7 ", "7.0").

    Null and empty arrays, null elements and elements whose key is null or no whole
    number give no rows. Repeats give repeated rows. ``values`` are further element
    fields. Empty tables give an empty result.
    """
    dtype = {f.name: f.dataType for f in df.schema.fields}
    first = next(iter(lists.values()))
    element = {f.name: f.dataType for f in dtype[first].elementType.fields}
    schema = "record_kind string, parent_id long, child_id long, ordinal int"
    schema += "".join(f", `{c}` {dtype[c].simpleString()}" for c in carry) + "".join(f", `{v}` {element[v].simpleString()}" for v in values)
    labels, columns = list(lists), list(lists.values())
    ncarry = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, label in enumerate(labels):
                array = batch.column(1 + ncarry + k)
                offsets = array.offsets.to_numpy()
                length = np.diff(offsets)
                missing = array.is_null().to_numpy(zero_copy_only=False)
                items = array.values.slice(offsets[0], offsets[-1] - offsets[0])
                owner = np.repeat(np.arange(len(array)), length)
                ordinal = np.arange(len(owner)) - np.repeat(offsets[:-1] - offsets[0], length)
                key = pc.utf8_trim_whitespace(pc.cast(pc.struct_field(items, item_key), pa.string()))
                # a frame holds few different keys, so each is read once, by the rule for text
                codes = pc.dictionary_encode(key)
                ids = pa.array([None if k is None else whole_number(k) for k in codes.dictionary.to_pylist()], pa.int64())
                child = ids.take(codes.indices)
                keep = pc.and_(pc.is_valid(items), pc.is_valid(child)).to_numpy(zero_copy_only=False) & ~missing[owner]
                take = pa.array(np.flatnonzero(keep))
                child = child.take(take)
                up = pa.array(owner[keep])
                out = [pa.array([label] * len(up), pa.string()), batch.column(0).take(up), child, pa.array(ordinal[keep], pa.int32())]
                out += [batch.column(1 + c).take(up) for c in range(ncarry)]
                out += [pc.struct_field(items, v).take(take) for v in values]
                names = ["record_kind", "parent_id", "child_id", "ordinal", *carry, *values]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return df.select(F.col(id_col).cast("long"), *carry, *columns).mapInArrow(run, schema)


def whole_number_column(column: Column) -> Column:
    """``whole_number`` for a string column, inside the JVM: null where it isn't one."""
    text = F.trim(column)
    short = F.regexp_replace(text, r"\.0*$", "").try_cast("decimal(38,0)").try_cast("long")
    number = text.try_cast("double")
    long = F.when(text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & (F.abs(number) < float(2**53)) & (number == F.floor(number)), number.cast("long"))
    return F.when(text.rlike(_WHOLE_SQL), short).otherwise(long)
