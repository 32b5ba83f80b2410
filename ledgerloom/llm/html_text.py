"""Main text of web pages by wrapper induction.

The pages of a host are aligned: their trees of blocks are matched by simple tree matching (equal labels, largest
order-preserving matching of children), and what is matched becomes one node of the host's *wrapper*.  Siblings in a
row with one label count as one repeated node, so lists of any length align; ids are no part of a label.  A text that
stands in one slot of nearly all pages of a host (``SHARE`` of at least ``PAGES``) is template; slots whose text varies
are content.  The host's *region* is the smallest node around most of the varying, unlinked text of all its pages
(``MOST``), an article or main element at the innermost; what lies outside of it on a page goes, whatever its name.

Pages are aligned within each task first, and a host's partial wrappers are aligned with each other afterwards, so a
large host costs one small wrapper per task.  A wrapper holds no texts, and it lets go of nodes that fewer than one in
``RARE`` of its pages have: a node that nearly all pages have is no such in at least one task.  The pages are then laid
on their host's whole wrapper, and the pages that have a text in a slot are counted exactly, by an aggregate over
(host, slot, text) with partial sums in each task, as are the characters of a slot; the constant texts that are left
are at most some more than a page has.

A page's main text are the blocks of its main container without template texts and without blocks that are menus,
headers, footers, sidebars, notices, adverts, forms or reader comments by their element, class, id or role.  The
container is the article or main element with most text in the region; pages without one take the smallest block around
most of their unlinked text there.  Pages with nothing in the region, and those of hosts with few pages, go without it.
If template texts were more than half of a container's text, as where a host serves one article many times, they stay.

A null html is empty, and its text is empty; a page without main text has an empty text.  A null or broken url belongs
to no host.  Equal rows get equal texts.  An empty table gives an empty one.  Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import MAIN_TAGS, MAIN_WORDS, Block, Text, read
from .exchange import arrow_map, parts, saved, small_batches

SHARE, PAGES, MOST, RARE = 0.9, 5, 0.8, 50
#: Hosts that a task holds before it sends their wrappers; bytes of wrappers that are broadcast.
HOSTS, BROADCAST_BYTES = 5000, 8 << 20


class Slot:
    """A node of a wrapper: pages that have it and its children; of a page, also its blocks and texts."""

    __slots__ = ("label", "pages", "number", "kids", "held", "blocks")

    def __init__(self, label: str, pages: int = 1, number: int = 0):
        self.label, self.pages, self.number = label, pages, number
        self.kids: list[Slot] = []
        self.held: list[Text] = []
        self.blocks: list[Block] = []


def key(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 32 | zlib.adler32(data)) - (1 << 63)


def slots(block: Block) -> Slot:
    """A page as a wrapper of its own; siblings in a row with one label are one slot."""
    out = Slot(block.label)
    out.blocks.append(block)
    for kid in block.kids:
        if isinstance(kid, Text):
            out.held.append(kid)
            continue
        own = slots(kid)
        if out.kids and out.kids[-1].label == own.label:
            out.kids[-1] = merged(out.kids[-1], own, False)
        else:
            out.kids.append(own)
    return out


def match(a: Slot, b: Slot) -> int:
    """Simple tree matching: the number of pairs in the largest matching that keeps labels, order and parents."""
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    above = [0] * (len(b.kids) + 1)
    for x in a.kids:
        row = [0]
        for j, y in enumerate(b.kids):
            best = max(above[j + 1], row[j])
            row.append(max(best, above[j] + match(x, y)) if x.label == y.label else best)
        above = row
    return above[-1] + 1


def aligned(a: list[Slot], b: list[Slot]) -> list[tuple[Slot | None, Slot | None]]:
    """Children of matched nodes in a common order; one side is None where the other has nothing like it."""
    if [x.label for x in a] == [x.label for x in b]:
        return list(zip(a, b, strict=True))
    size = [[match(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], size[i][j] + best[i + 1][j + 1] if size[i][j] else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if size[i][j] and best[i][j] == size[i][j] + best[i + 1][j + 1]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out + [(x, None) for x in a[i:]] + [(None, y) for y in b[j:]]


def merged(a: Slot, b: Slot, pages: bool = True) -> Slot:
    """Two wrappers of different pages as one; or two siblings of one page (``pages`` false)."""
    a.pages = a.pages + b.pages if pages else max(a.pages, b.pages)
    a.held += b.held
    a.blocks += b.blocks
    kids: list[Slot] = []
    for x, y in aligned(a.kids, b.kids):
        one = merged(x, y, pages) if x and y else x or y
        if kids and kids[-1].label == one.label:
            kids[-1] = merged(kids[-1], one, False)
        else:
            kids.append(one)
    a.kids = kids
    return a


def dump(slot: Slot) -> list:
    return [slot.label, slot.pages, [dump(x) for x in slot.kids]]


def undump(data: list, numbers: Iterator[int] | None = None) -> Slot:
    """The wrapper, its slots numbered in the order of the data."""
    numbers = numbers or count()
    out = Slot(data[0], data[1], next(numbers))
    out.kids = [undump(x, numbers) for x in data[2]]
    return out


def pruned(wrapper: Slot) -> Slot:
    """The wrapper without texts and without nodes that few of its pages have."""
    todo = [wrapper]
    while todo:
        x = todo.pop()
        x.held, x.blocks = [], []
        x.kids = [kid for kid in x.kids if RARE * kid.pages >= wrapper.pages]
        todo += x.kids
    return wrapper


def placed(page: Slot, wrapper: Slot) -> list[tuple[Slot, Slot]]:
    """The page's nodes, each with the wrapper's that it is matched with."""
    out, todo = [], [(page, wrapper)]
    while todo:
        pair = todo.pop()
        out.append(pair)
        todo += [(a, b) for a, b in aligned(pair[0].kids, pair[1].kids) if a and b]
    return out


class Template:
    """A host's wrapper, its template texts by slot, and the slots in its region or around it."""

    def __init__(self, wrapper: Slot, slots: list[tuple[int, int, list[int]]]):
        self.wrapper = wrapper
        self.constants = {(slot, x) for slot, _, texts in slots for x in texts}
        own = {slot: weight for slot, weight, _ in slots}
        order = [wrapper]
        for x in order:
            order += x.kids
        total: dict[int, int] = {}
        for x in reversed(order):
            total[x.number] = own.get(x.number, 0) + sum(total[kid.number] for kid in x.kids)
        here, self.around = wrapper, {wrapper.number}
        while here.label.split()[0] not in MAIN_TAGS:
            best = max(here.kids, key=lambda x: total[x.number], default=None)
            if best is None or not best.kids or total[best.number] < MOST * total[here.number] or not total[best.number]:
                break
            here = best
            self.around.add(here.number)
        self.region = {here.number}
        inner = [here]
        for x in inner:
            inner += x.kids
        self.region |= {x.number for x in inner}

    def lay(self, root: Block) -> None:
        """Marks the page's template texts, and bars its blocks outside the region if it has any text in it."""
        found = placed(slots(root), self.wrapper)
        for page, slot in found:
            for text in page.held:
                text.constant = (slot.number, key(text.text)) in self.constants
        if not any(x.held for x, y in found if y.number in self.region):
            return
        inside = {id(x) for page, slot in found if slot.number in self.around for x in page.blocks}
        region = {id(x) for page, slot in found if slot.number in self.region and slot.number in self.around for x in page.blocks}
        todo = [root]
        while todo:
            x = todo.pop()
            if id(x) in region:
                continue
            for kid in x.blocks():
                if id(kid) in inside:
                    todo.append(kid)
                else:
                    kid.barred = True


def _weights(root: Block) -> dict[int, tuple[int, int]]:
    """Of each block the characters that aren't barred, and the unlinked ones of them that aren't template."""
    order = [root]
    for x in order:
        order += [kid for kid in x.blocks() if not kid.barred]
    out: dict[int, tuple[int, int]] = {}
    for x in reversed(order):
        whole = free = 0
        for kid in x.kids:
            if isinstance(kid, Text):
                whole += len(kid.text)
                free += 0 if kid.constant else max(0, len(kid.text) - kid.linked)
            elif id(kid) in out:
                whole, free = whole + out[id(kid)][0], free + out[id(kid)][1]
        out[id(x)] = whole, free
    return out


def container(root: Block) -> Block:
    """Where the main text lies."""
    found: list[Block] = []
    named: list[Block] = []
    weight = _weights(root)
    todo = [root]
    while todo:
        x = todo.pop()
        if x.barred:
            continue
        if x.tag in MAIN_TAGS or "main" in x.words:
            found.append(x)
        elif x.words & MAIN_WORDS:
            named.append(x)
        todo.extend(x.blocks())
    articles = [x for x in found if x.tag == "article"]
    for choice in (articles, found):
        if choice and weight[id(best := max(choice, key=lambda x: weight[id(x)][0]))][0]:
            return best
    total = weight[id(root)][1]
    named = [x for x in named if 2 * weight[id(x)][1] > total]
    if named:
        return min(named, key=lambda x: weight[id(x)][0])
    here = root
    while True:
        inner = [x for x in here.blocks() if not x.barred]
        best = max(inner, key=lambda x: weight[id(x)][1], default=None)
        if best is None or 10 * weight[id(best)][1] < 8 * weight[id(here)][1] or not best.blocks():
            return here
        here = best


def main_text(html: str | None, template: Template | None = None) -> str:
    root = read(html)
    if template is not None:
        template.lay(root)
    block = container(root)
    texts = list(block.texts())
    constant = sum(len(x.text) for x in texts if x.constant)
    keep = 2 * constant > sum(len(x.text) for x in texts)
    return "\n".join(x.text for x in texts if keep or not x.constant)


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Slot] = {}

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(dump(pruned(x)), ensure_ascii=False) for x in held.values()], pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = slots(read(html.as_py()))
            whole = held[host] = merged(held[host], page) if host in held else page
            if whole.pages % RARE == 0 or len(held) > 1 and whole.pages == 1:
                pruned(whole)
            if len(held) >= HOSTS:
                yield flush()
                held = {}
    if held:
        yield flush()


def _join_wrappers(pages: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, whole, out = None, None, []

        def done() -> None:
            if whole is not None and whole.pages >= pages:
                out.append((host, json.dumps(dump(pruned(whole)), ensure_ascii=False)))

        for batch in batches:
            for name, data in zip(batch.column("host").to_pylist(), batch.column("wrapper"), strict=True):
                part = undump(json.loads(data.as_py()))
                if name == host:
                    whole = merged(whole, part)
                else:
                    done()
                    host, whole = name, part
        done()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["host", "wrapper"])

    return join


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Slot] = {}
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for host, html, data in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("wrapper"), strict=True):
            if host not in known:
                if len(known) >= HOSTS:
                    known.clear()
                known[host] = undump(json.loads(data.as_py()))
            own: dict[tuple, int] = {}
            for page, slot in placed(slots(read(html.as_py())), known[host]):
                for text in page.held:
                    at = (host, known[host].pages, slot.number, key(text.text))
                    own[at] = own.get(at, 0) + max(0, len(text.text) - text.linked)
            for at, weight in own.items():
                count = seen.setdefault(at, [0, 0])
                count[0] += 1
                count[1] += weight
        columns = zip(*seen, strict=True) if seen else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        sums = [pa.array([x[i] for x in seen.values()], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), *sums], names=["host", "pages", "slot", "text", "n", "weight"])


def _few(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its wrappers are small."""
    size = df.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).head()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def wrappers(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(host, wrapper, slots) of every host with enough pages; ``pages`` has ``host`` and ``html``."""
    own = pages.where("host is not null").select("host", "html")
    partial = arrow_map(own, _induce, "host string, wrapper string")
    dealt = partial.repartition(parts(pages.sparkSession), "host").sortWithinPartitions("host", "wrapper")
    whole = saved(arrow_map(dealt, _join_wrappers(least), "host string, wrapper string"), "hosts")
    counts = arrow_map(own.join(_few(whole), "host").select("host", "html", "wrapper"), _count, "host string, pages long, slot int, text long, n long, weight long")
    texts = counts.groupBy("host", "pages", "slot", "text").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    constant = F.col("n") >= share * F.col("pages")
    slots_ = texts.groupBy("host", "slot").agg(F.sum(F.when(constant, 0).otherwise(F.col("weight"))).alias("weight"), F.collect_list(F.when(constant, F.col("text"))).alias("texts"))
    return whole.join(slots_.groupBy("host").agg(F.collect_list(F.struct("slot", "weight", "texts")).alias("slots")), "host")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for batch in batches:
        texts = []
        for host, html, data, own in zip(*(batch.column(c) for c in ("host", "html", "wrapper", "slots")), strict=True):
            if not data.is_valid:
                texts.append(main_text(html.as_py()))
                continue
            if (name := host.as_py()) not in known:
                if len(known) >= HOSTS:
                    known.clear()
                known[name] = Template(undump(json.loads(data.as_py())), [(x["slot"], x["weight"], x["texts"]) for x in own.as_py()])
            texts.append(main_text(html.as_py(), known[name]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    small_batches(pages.sparkSession)
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"), F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("host"))
    found = saved(wrappers(rows, share, least), "wrappers")
    joined = rows.join(_few(found), "host", "left")
    return arrow_map(joined.select("page_id", "url", "host", "html", "wrapper", "slots"), _extract, "page_id long, url string, text string, n_chars long")
