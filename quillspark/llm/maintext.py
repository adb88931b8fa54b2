"""Main text of web pages: markup roles, then repeated runs found by a suffix array of each host.

A tolerant parser cuts each page in blocks, leaves out what markup names as something else than the text (menus, headers, footers,
sidebars, adverts, forms, notices, comments, scripts) and keeps the article, or all that is left where a page marks none. The
blocks of a host's pages are put together as one stream of words, pages and their ends told apart. Its suffixes are ordered by
prefix doubling up to ``least`` words: suffixes of equal rank begin with the same run. A run is boilerplate if it is on
``share`` of the host's pages of different content, and on ``pages`` of them at least; copies of a page count as one page, so that an
article that a host shows under several addresses is not boilerplate. Blocks that such runs cover are left out; a block with any
word of its own is unique and stays whole.

Hosts of more than ``group_bytes`` of pages or ``group_pages`` pages are dealt to groups by hash of the words of the page. A run on ``share``
of a host's contents is on as large a share in one group at least, so groups propose runs, and those proposed are counted on all of the host's
pages: the result does not depend on the groups. Runs are told apart by 64-bit hashes. Pages are parsed again where they are; only the words of
different pages are shuffled.

Null and empty pages have an empty text, and so have pages without blocks. Null and broken addresses are one host, with no name. Very
long pages are parsed whole; one longer than a group makes that group longer. Repeated rows give repeated results. There are no
ties: every run over the threshold goes. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, raw_texts
from quillspark.llm.orderminhash import _mix, _Numbers

LEAST, SHARE, PAGES = 5, 0.5, 4
GROUP_BYTES, GROUP_PAGES = 4 << 20, 512
#: Copies of a page are known again among so many pages of a task.
SEEN = 1_000_000

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
_INLINE_BREAK = {"br", "td", "th"}
#: Elements that are not text of the page, whatever is around them.
_NEVER = set("audio button canvas datalist dialog form iframe input label math menu nav noscript object script select style svg template textarea title video footer aside".split())
#: Elements that hold others and are closed by name.
_HOLDERS = (_BLOCK | _NEVER | {"span", "header"}) - {"p", "li", "dt", "dd", "tr", "option", "hr", "html", "body", "input"}
_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id names that mark what is not the article.
_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget".split()
)
_LAYOUT = re.compile(r"^(has|with|no|is|js|without)[-_]")


def _aside(tag: str, attrs: list[tuple[str, str | None]], in_text: bool) -> bool:
    """Whether an element holds something else than the text."""
    if tag in _NEVER or tag == "header" and not in_text:
        return True
    if tag in ("html", "body"):
        return False
    named = {k: v or "" for k, v in attrs}
    if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
        return True
    if named.get("role", "").lower() in _ROLES:
        return True
    for name in f"{named.get('class', '')} {named.get('id', '')}".split():
        if not _LAYOUT.match(name) and not _NAMES.isdisjoint(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())):
            return True
    return False


class _Blocks(HTMLParser):
    """Blocks of a page, each with whether it is inside a marked article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool]] = []
        self.words: list[str] = []
        self.open: list[tuple[str, bool, bool]] = []  # name, aside, text

    def _state(self) -> tuple[bool, bool]:
        return self.open[-1][1:] if self.open else (False, False)

    def end_block(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.blocks.append((text, self._state()[1]))
        self.words = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK or tag in _NEVER:
            self.end_block()
        elif tag in _INLINE_BREAK:
            self.words.append(" ")
        if tag in _VOID or tag not in _HOLDERS:
            return
        aside, text = self._state()
        self.open.append((tag, aside or _aside(tag, attrs, text), text or tag in ("article", "main") or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _HOLDERS and tag not in _VOID and tag in ("svg", "math", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK or tag in _NEVER:
            self.end_block()
        if tag in _HOLDERS:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
            if at is not None:
                del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.words.append(data)


def blocks_of(html: str) -> list[str]:
    """The blocks that can be text: those of the article, or all where none is marked."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    marked = [text for text, inside in parser.blocks if inside]
    return marked or [text for text, _ in parser.blocks]


def _words(html: bytes) -> tuple[list[str], bytes]:
    """The blocks of a page, and all its words, separated by blanks."""
    blocks = blocks_of(html.decode("utf-8", "replace"))
    return blocks, " ".join(blocks).encode("utf-8", "replace")


def _runs(numbers: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the runs of so many words, one for each start."""
    n = max(0, len(numbers) - least + 1)
    out = np.zeros(n, np.uint64)
    for i in range(least):
        out = _mix(out + numbers[i : i + n])
    return out.view(np.int64)


def _content(words: bytes) -> int:
    return int.from_bytes(blake2b(words, digest_size=8).digest(), "little", signed=True)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, content, words of the pages; most copies of a page that one task meets again are left out."""
    seen = set()
    for batch in batches:
        hosts, contents, words = [], [], []
        for host, raw in zip(batch.column("host").to_pylist(), raw_texts(batch.column("html")), strict=True):
            page = _words(raw)[1]
            key = (host, _content(page))
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                hosts.append(host)
                contents.append(key[1])
                words.append(page)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(words, pa.binary())], names=["host", "content", "words"])


def starts_of(streams: list[np.ndarray], least: int, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start that at least so many of the different streams have (in the streams put together), and how many have each."""
    lengths = np.array([len(s) for s in streams], np.int64)
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct: dict[bytes, int] = {}
    content = np.array([distinct.setdefault(s.tobytes(), len(distinct)) for s in streams], np.int64)
    page = np.repeat(np.arange(len(streams)), lengths)
    # ranks of the suffixes by ever more of their first words; those that end before `least` words are alone
    rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    whole = np.flatnonzero(left >= least)
    known = 1
    while known < least:
        step = min(known, least - known)
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        following[left <= step] = 0
        rank = np.unique(rank * (n + 2) + following, return_inverse=True)[1].astype(np.int64)
        known += step
    pairs = np.unique(rank[whole] * len(distinct) + content[page[whole]])
    on = np.bincount(pairs // len(distinct), minlength=n + 1)[rank[whole]]
    return whole[on >= enough], on[on >= enough]


def repeated(streams: list[np.ndarray], least: int = LEAST, share: float = SHARE, pages: int = PAGES) -> list[np.ndarray]:
    """For each stream of word numbers, which words are covered by a run that so many different streams have."""
    starts, _ = starts_of(streams, least, max(pages, share * len({s.tobytes() for s in streams})))
    lengths = [len(s) for s in streams]
    cover = np.zeros(sum(lengths) + 1, np.int64)
    cover[starts] += 1
    np.subtract.at(cover, starts + least, 1)
    return np.split(np.cumsum(cover[:-1]) > 0, np.cumsum(lengths)[:-1])


def _candidates(least: int, share: float):  # noqa: ANN202
    """host, run, n of the runs on the share of a group's contents at least; run is null in the row of the number of contents."""

    def find(table: pa.Table) -> pa.Table:
        words = dict(zip(table.column("content").to_pylist(), table.column("words").to_pylist(), strict=True))
        number = _Numbers()
        streams = [number.of(w.decode().split()) for w in words.values()]
        starts, on = starts_of(streams, least, share * len(streams))
        every = np.concatenate(streams)
        hashes = np.zeros(len(every), np.int64)
        hashes[: max(0, len(every) - least + 1)] = _runs(every, least)
        runs, at = np.unique(hashes[starts], return_index=True)
        return pa.table({"host": pa.array([table.column("host")[0].as_py()] * (len(runs) + 1), pa.string()), "run": pa.array([None, *runs.tolist()], pa.int64()), "n": pa.array([len(streams), *on[at].tolist()], pa.int64())})

    return find


def _found(least: int):  # noqa: ANN202
    """host, content, at: where in its host's list of runs those of a page are."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        for batch in batches:
            contents, at = [], []
            for raw, runs in zip(raw_texts(batch.column("html")), batch.column("runs"), strict=True):
                page = _words(raw)[1]
                contents.append(_content(page))
                at.append(np.flatnonzero(np.isin(runs.values.to_numpy(), _runs(number.of(page.decode().split()), least))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(contents, pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["host", "content", "at"])

    return find


def _texts(least: int):  # noqa: ANN202
    """The texts of pages without the blocks that their host's runs cover."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        for batch in batches:
            out = []
            for raw, runs in zip(raw_texts(batch.column("html")), batch.column("runs"), strict=True):
                blocks, page = _words(raw)
                if runs.is_valid:
                    numbers = number.of(page.decode().split())
                    cover = np.zeros(len(numbers) + 1, np.int64)
                    starts = np.flatnonzero(np.isin(_runs(numbers, least), runs.values.to_numpy()))
                    cover[starts] += 1
                    np.subtract.at(cover, starts + least, 1)
                    covered = np.cumsum(cover[:-1]) > 0
                    ends = np.cumsum([len(b.split()) for b in blocks])
                    blocks = [b for b, end in zip(blocks, ends, strict=True) if not covered[end - len(b.split()) : end].all()]
                out.append("\n\n".join(blocks))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return texts


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", least: int = LEAST, share: float = SHARE, min_pages: int = PAGES, group_bytes: int = GROUP_BYTES, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text (blocks joined by an empty line), n_chars: one row per row of pages."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    hosts = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("host_bytes"), F.count("*").alias("n"))
    groups = F.ceil(F.greatest((F.col("host_bytes") + 1) / F.lit(group_bytes), F.col("n") / F.lit(group_pages))).cast("long")
    # few hosts need more than one group: Spark broadcasts their table while it is small, and joins by shuffle beyond
    several = materialize(hosts.select("host", groups.alias("groups")).where("groups > 1"), "main-hosts")
    dealt = rows.select("host", "html").mapInArrow(_contents, "host string, content long, words binary").join(several, "host", "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod("content", "groups"), F.lit(0).cast("long"))).drop("groups")
    found = materialize(dealt.groupBy("host", "part").applyInArrow(_candidates(least, share), "host string, run long, n long"), "main-candidates")

    enough = found.where("run is null").groupBy("host").agg(F.greatest(F.lit(float(min_pages)), F.lit(float(share)) * F.sum("n")).alias("enough"))
    one = found.where("run is not null").join(several, "host", "left_anti").select("host", "run", "n")
    # a run of a host of several groups is counted on all its pages
    listed = found.where("run is not null").join(several, "host", "left_semi").groupBy("host").agg(F.array_sort(F.collect_set("run")).alias("runs"))  # a few times as many as a page has words
    listed = materialize(listed, "main-listed")
    met = rows.select("host", "html").join(listed, "host").mapInArrow(_found(least), "host string, content long, at array<int>")
    met = met.groupBy("host", "content").agg(F.first("at").alias("at")).select("host", F.explode("at").alias("at")).groupBy("host", "at").agg(F.count("*").alias("n"))
    many = met.join(listed.select("host", F.posexplode("runs").alias("at", "run")), ["host", "at"]).select("host", "run", "n")
    runs = one.unionByName(many).join(enough, "host").where("n >= enough").groupBy("host").agg(F.collect_list("run").alias("runs"))
    runs = materialize(runs, "main-runs")
    kinds = {k: rows.schema[k].dataType.simpleString() for k in ("page_id", "url")}
    judged = rows.join(runs, "host", "left").mapInArrow(_texts(least), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return judged.withColumn("n_chars", F.char_length("text").cast("long"))


def op13(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
