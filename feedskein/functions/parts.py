"""Well-formed documents cut into smaller ones at their repeated elements.

One streaming pass of the XML tokenizer finds where the elements start and end, so tags in
comments, CDATA sections and attribute values are never taken for elements. A document becomes
a rest, which is the document without those elements, and parts, each a run of elements inside
the start tags that enclose them. All are well-formed documents of their own.
"""

import re
import sys
from xml.parsers import expat

from pyspark import cloudpickle

# executors get these functions with the jobs that use them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_START_TAG = re.compile(rb"<(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_CHUNK = 1 << 20


class _Uncut(Exception):
    """The document has to be read whole."""


def element_ranges(data, paths):
    """([(start, end)], [start of each enclosing element]) of the elements at one of `paths`
    (tuples of names from the root), in bytes. None if the document is not well-formed, has a
    document type (whose entities parts would lack), or has no such elements, or some below
    different parents or of different names."""
    longest = max(map(len, paths))
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = True
    names, starts, found, parents = [], [], [], set()

    def start(name, _):
        names.append(name)
        starts.append(parser.CurrentByteIndex)

    def end(name):
        if len(names) <= longest and tuple(names) in paths:
            at = parser.CurrentByteIndex
            tag = b"</" + name.encode()
            # an empty-element tag ends where its end is reported
            stop = data.find(b">", at) + 1 if data[at:at + len(tag)] == tag else at
            found.append((starts[-1], stop))
            parents.add((name, *starts[:-1]))
            if len(parents) > 1:
                raise _Uncut
        names.pop()
        starts.pop()

    def doctype(*_):
        raise _Uncut

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, doctype
    try:
        for begin in range(0, len(data), _CHUNK):
            parser.Parse(data[begin:begin + _CHUNK], False)
        parser.Parse(b"", True)
    except (expat.ExpatError, ValueError, _Uncut):
        return None
    return (found, list(next(iter(parents)))[1:]) if found else None


def document_parts(data, paths, part_bytes):
    """(elements before, elements within, elements in all, document) of a UTF-8 document: first the
    rest, without elements, then the parts, each of as many elements as reach `part_bytes`, at
    least one. Nothing for a document that has to be read whole, see element_ranges, or whose enclosing
    tags and what precedes them come to more than a part."""
    ranges = element_ranges(data, paths)
    if ranges is None:
        return
    found, enclosing = ranges
    tags = [_START_TAG.match(data, at) for at in enclosing]
    head = data[:enclosing[0]] + b"".join(t.group() for t in tags)
    if len(head) > part_bytes:
        return
    tail = b"".join(b"</" + re.match(rb"<([^\s/>]+)", t.group()).group(1) + b">" for t in reversed(tags))
    edges = [0, *(x for pair in found for x in pair), len(data)]
    yield 0, 0, len(found), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
    first, size = 0, 0
    for i, (begin, end) in enumerate(found):
        size += end - begin
        if size >= part_bytes or i == len(found) - 1:
            yield first, i + 1 - first, len(found), head + b"".join(data[a:b] for a, b in found[first:i + 1]) + tail
            first, size = i + 1, 0
