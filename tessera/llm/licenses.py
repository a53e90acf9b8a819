"""License scan with ordered signature rules.

Method: a few hundred hand-written regular expressions, each gated by literals: a gate is a set of literals, and every match
has all literals of one of its rule's gates. A text is first tested for any gate (vectorised, no Python object is made for
the others), then one Aho-Corasick pass tells which literals it has, and only rules with a gate whose literals are all
present run, on the whole text.

Overlaps are settled by rank: higher priority first (a tag over a full notice, over an address, over a bare name), then the
longer match, the earlier start and the earlier rule. A detection that lies inside one of better rank is suppressed;
detections that merely overlap both stay.

Defined results: offsets are characters, the end exclusive; null and empty texts have no detections; null ids are reported
as null; repeated rows are scanned each; an empty table gives an empty result; other columns are ignored; texts are whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import tidy
from .common import table

L = r"licen[cs]e"
V = r"[\s,(]*(?:version|ver\.?|v\.?)?\s*"

# id | name | gates of the name, joined by ";", each with its literals, joined by ",", the first being what texts are tested for | address
_LICENSES = rf"""
MIT | (?:the\s+)?(?:mit|expat)[\s/-]+(?:x11\s+)?{L} | licen | opensource\.org/licenses?/mit(?![\w-])
MIT-0 | mit\s+no\s+attribution(?:\s+{L})? | attribution,mit | opensource\.org/licenses?/mit-0
X11 | x11\s+{L} | licen,x11 | www\.xfree86\.org/3\.3\.6/copyright2
ISC | isc\s+{L} | licen,isc | opensource\.org/licenses?/isc
Apache-1.0 | apache\s+(?:software\s+)?{L}{V}1\.0(?![\d.]*\d) | licen,apache | www\.apache\.org/licenses/license-1\.0
Apache-1.1 | apache\s+(?:software\s+)?{L}{V}1\.1 | licen,apache | www\.apache\.org/licenses/license-1\.1
Apache-2.0 | apache\s+(?:software\s+)?{L}{V}2(?:\.0)?(?!\.\d) | licen,apache | www\.apache\.org/licenses/license-2\.0
Apache | apache\s+(?:software\s+)?{L} | licen,apache | www\.apache\.org/licenses(?!/license)
BSD-1-Clause | (?:1|one)[\s-]clause\s+bsd | clause,bsd | opensource\.org/licenses?/bsd-1-clause
BSD-2-Clause | (?:(?:2|two)[\s-]clause|simplified|freebsd)\s+bsd | bsd | opensource\.org/licenses?/bsd-2-clause
BSD-3-Clause | (?:(?:3|three)[\s-]clause|new|modified|revised)\s+bsd | bsd | opensource\.org/licenses?/bsd-3-clause
BSD-4-Clause | (?:(?:4|four)[\s-]clause|original)\s+bsd | bsd | directory\.fsf\.org/wiki/license:bsd-4-clause
BSD | bsd\s+{L} | licen,bsd | opensource\.org/licenses?/bsd-license
0BSD | (?:zero[\s-]clause|0[\s-]clause|free\s+public)\s+(?:bsd|{L}\s+1\.0) | clause;free,public | opensource\.org/licenses?/0bsd
GPL-1.0 | gnu\s+general\s+public\s+{L}{V}1(?:\.0)?(?![\d.]*\d) | licen,gnu,general | www\.gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
GPL-2.0 | gnu\s+general\s+public\s+{L}{V}2(?:\.0)?(?![\d.]*\d) | licen,gnu,general | www\.gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
GPL-3.0 | gnu\s+general\s+public\s+{L}{V}3(?:\.0)?(?![\d.]*\d) | licen,gnu,general | www\.gnu\.org/licenses/gpl-3\.0
GPL | gnu\s+(?:general\s+public\s+{L}|gpl) | gnu | www\.gnu\.org/licenses/gpl(?![\w-])
LGPL-2.0 | gnu\s+library\s+(?:general\s+)?public\s+{L}(?:{V}2(?:\.0)?(?![\d.]*\d))? | licen,library | www\.gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
LGPL-2.1 | gnu\s+lesser\s+(?:general\s+)?public\s+{L}{V}2\.1 | licen,lesser | www\.gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
LGPL-3.0 | gnu\s+lesser\s+(?:general\s+)?public\s+{L}{V}3(?:\.0)? | licen,lesser | www\.gnu\.org/licenses/lgpl-3\.0
LGPL | gnu\s+lesser\s+(?:general\s+)?public\s+{L} | licen,lesser | www\.gnu\.org/licenses/lgpl(?![\w-])
AGPL-1.0 | affero\s+general\s+public\s+{L}{V}1(?:\.0)? | licen,affero | www\.affero\.org/oagpl
AGPL-3.0 | affero\s+general\s+public\s+{L}(?:{V}3(?:\.0)?)? | licen,affero | www\.gnu\.org/licenses/agpl(?:-3\.0)?
GFDL-1.1 | gnu\s+free\s+documentation\s+{L}{V}1\.1 | licen,documentation | www\.gnu\.org/licenses/(?:old-licenses/)?fdl-1\.1
GFDL-1.2 | gnu\s+free\s+documentation\s+{L}{V}1\.2 | licen,documentation | www\.gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
GFDL-1.3 | gnu\s+free\s+documentation\s+{L}(?:{V}1\.3)? | licen,documentation | www\.gnu\.org/licenses/fdl-1\.3
MPL-1.0 | mozilla\s+public\s+{L}{V}1\.0 | licen,mozilla | www\.mozilla\.org/mpl/mpl-1\.0
MPL-1.1 | mozilla\s+public\s+{L}{V}1\.1 | licen,mozilla | www\.mozilla\.org/mpl/(?:mpl-)?1\.1
MPL-2.0 | mozilla\s+public\s+{L}(?:{V}2(?:\.0)?)? | licen,mozilla | (?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0
EPL-1.0 | eclipse\s+public\s+{L}{V}1(?:\.0)? | licen,eclipse | www\.eclipse\.org/legal/epl-v10
EPL-2.0 | eclipse\s+public\s+{L}(?:{V}2(?:\.0)?)? | licen,eclipse | www\.eclipse\.org/legal/epl-(?:2\.0|v20)
EDL-1.0 | eclipse\s+distribution\s+{L} | licen,eclipse | www\.eclipse\.org/org/documents/edl-v10
CDDL-1.0 | common\s+development\s+and\s+distribution\s+{L}(?:{V}1\.0)? | licen,development | opensource\.org/licenses?/cddl-1\.0
CDDL-1.1 | common\s+development\s+and\s+distribution\s+{L}{V}1\.1 | licen,development | glassfish\.java\.net/public/cddl\+gpl_1_1
CPL-1.0 | common\s+public\s+{L}(?:{V}1\.0)? | licen,common | opensource\.org/licenses?/cpl1\.0
EUPL-1.1 | european\s+union\s+public\s+{L}{V}1\.1 | licen,european | joinup\.ec\.europa\.eu/software/page/eupl/licence-eupl
EUPL-1.2 | european\s+union\s+public\s+{L}(?:{V}1\.2)? | licen,european | joinup\.ec\.europa\.eu/collection/eupl
BSL-1.0 | boost\s+software\s+{L}(?:{V}1(?:\.0)?)? | licen,boost | www\.boost\.org/license_1_0
BUSL-1.1 | business\s+source\s+{L}(?:{V}1\.1)? | licen,business | mariadb\.com/bsl11
Artistic-1.0 | artistic\s+{L}{V}1(?:\.0)? | licen,artistic | opensource\.org/licenses?/artistic-license-1\.0
Artistic-2.0 | artistic\s+{L}(?:{V}2(?:\.0)?)? | licen,artistic | www\.perlfoundation\.org/artistic_license_2_0
Zlib | (?:zlib|zlib/libpng)\s+{L} | licen,zlib | www\.zlib\.net/zlib_license
Libpng | libpng\s+{L} | licen,libpng | www\.libpng\.org/pub/png/src/libpng-license
Unlicense | the\s+unlicense | unlicense | unlicense\.org
WTFPL | (?:do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public\s+{L}|wtfpl) | wtfpl;fuck,licen | www\.wtfpl\.net
CC0-1.0 | (?:cc0|creative\s+commons\s+zero)(?:{V}1\.0)?(?:\s+universal)? | cc0;zero,commons | creativecommons\.org/publicdomain/zero/1\.0
CC-PDDC | public\s+domain\s+dedication | domain,dedication | creativecommons\.org/licenses/publicdomain
CC-PDM-1.0 | public\s+domain\s+mark(?:{V}1\.0)? | domain,mark | creativecommons\.org/publicdomain/mark/1\.0
PSF-2.0 | (?:python\s+software\s+foundation|psf)\s+{L} | licen | docs\.python\.org/3/license
Python-2.0 | python\s+{L}{V}2(?:\.0)? | licen,python | opensource\.org/licenses?/python-2\.0
PHP-3.01 | php\s+{L}(?:{V}3\.01)? | licen,php | www\.php\.net/license/3_01
Ruby | ruby(?:'s)?\s+{L} | licen,ruby | www\.ruby-lang\.org/en/about/license
Perl | (?:same\s+terms\s+as\s+perl(?:\s+itself)?) | perl,terms | dev\.perl\.org/licenses
OpenSSL | openssl\s+{L} | licen,openssl | www\.openssl\.org/source/license
SSLeay | (?:original\s+)?ssleay\s+{L} | licen,ssleay | h71000\.www7\.hp\.com/doc/83final/ba554_90007/apcs02
OFL-1.0 | (?:sil\s+)?open\s+font\s+{L}{V}1\.0 | licen,font | scripts\.sil\.org/ofl10
OFL-1.1 | (?:sil\s+)?open\s+font\s+{L}(?:{V}1\.1)? | licen,font | scripts\.sil\.org/ofl(?!10)
ODbL-1.0 | open\s+(?:data\s+commons\s+)?(?:open\s+)?database\s+{L} | licen,database | opendatacommons\.org/licenses/odbl
ODC-By-1.0 | open\s+data\s+commons\s+attribution\s+{L} | licen,attribution | opendatacommons\.org/licenses/by
PDDL-1.0 | open\s+data\s+commons\s+public\s+domain\s+dedication | domain,commons | opendatacommons\.org/licenses/pddl
CDLA-Permissive-1.0 | community\s+data\s+{L}\s+agreement\W+permissive{V}1\.0 | licen,community | cdla\.dev/permissive-1-0
CDLA-Permissive-2.0 | community\s+data\s+{L}\s+agreement\W+permissive(?:{V}2\.0)? | licen,community | cdla\.dev/permissive-2-0
CDLA-Sharing-1.0 | community\s+data\s+{L}\s+agreement\W+sharing | licen,community | cdla\.dev/sharing-1-0
MS-PL | microsoft\s+public\s+{L} | licen,microsoft | opensource\.org/licenses?/ms-pl
MS-RL | microsoft\s+reciprocal\s+{L} | licen,microsoft | opensource\.org/licenses?/ms-rl
AFL-3.0 | academic\s+free\s+{L}(?:{V}3\.0)? | licen,academic | opensource\.org/licenses?/afl-3\.0
OSL-3.0 | open\s+software\s+{L}(?:{V}3\.0)? | licen,open | opensource\.org/licenses?/osl-3\.0
QPL-1.0 | q\s+public\s+{L} | licen,public | opensource\.org/licenses?/qpl-1\.0
NCSA | (?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?\s+{L} | licen,ncsa | otm\.illinois\.edu/uiuc_openSource
NPL-1.1 | netscape\s+public\s+{L} | licen,netscape | www\.mozilla\.org/mpl/npl
APSL-2.0 | apple\s+public\s+source\s+{L} | licen,apple | www\.opensource\.apple\.com/license/apsl
IPL-1.0 | ibm\s+public\s+{L} | licen,ibm | opensource\.org/licenses?/ipl-1\.0
SSPL-1.0 | server\s+side\s+public\s+{L} | licen,server | www\.mongodb\.com/licensing/server-side-public-license
Elastic-2.0 | elastic\s+{L}(?:{V}2(?:\.0)?)? | licen,elastic | www\.elastic\.co/licensing/elastic-license
CECILL-2.1 | cecill(?:[\s-]+2\.1|\s+free\s+software\s+{L}) | cecill | www\.cecill\.info/licences/licence_cecill_v2\.1
CECILL-B | cecill-b(?!\w) | cecill | www\.cecill\.info/licences/licence_cecill-b
CECILL-C | cecill-c(?!\w) | cecill | www\.cecill\.info/licences/licence_cecill-c
MulanPSL-2.0 | mulan\s+(?:permissive\s+software\s+{L}|psl)(?:{V}2)? | mulan | license\.coscl\.org\.cn/mulanpsl2
UPL-1.0 | universal\s+permissive\s+{L} | licen,universal | oss\.oracle\.com/licenses/upl
Vim | vim\s+{L} | licen,vim | vimdoc\.sourceforge\.net/htmldoc/uganda
Beerware | beer[\s-]?ware\s+{L} | licen,beer | people\.freebsd\.org/~phk
JSON | the\s+software\s+shall\s+be\s+used\s+for\s+good,\s+not\s+evil | evil | www\.json\.org/license
OpenRAIL-M | (?:creativeml\s+)?open\s*rail(?:[+\s-]+m)?(?:\s+{L})? | rail,open | huggingface\.co/spaces/compvis/stable-diffusion-license
Llama-2 | llama\s+2\s+community\s+{L} | licen,llama | ai\.meta\.com/llama/license
"""
_COMMONS = {"BY": "attribution", "BY-SA": r"attribution[\s-]+share\s*-?alike", "BY-ND": r"attribution[\s-]+no\s*-?deriv(?:ative)?s(?:\s+works)?",
            "BY-NC": r"attribution[\s-]+non\s*-?commercial", "BY-NC-SA": r"attribution[\s-]+non\s*-?commercial[\s-]+share\s*-?alike",
            "BY-NC-ND": r"attribution[\s-]+non\s*-?commercial[\s-]+no\s*-?deriv(?:ative)?s(?:\s+works)?"}
# full notices: id | text | gates
_NOTICES = r"""
MIT | permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy | hereby,granted
ISC | permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose | permission,modify
BSD | redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification | redistribution
GPL | this\s+program\s+is\s+free\s+software[:;]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify | redistribute
LGPL | this\s+library\s+is\s+free\s+software[:;]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify | redistribute
Zlib | this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty | warranty
Unlicense | this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain | unencumbered
BSL-1.0 | permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization\s+obtaining | hereby,organization
MPL-2.0 | this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public | mozilla
LicenseRef-public-domain | (?:released|placed|dedicated)\s+(?:in)?to\s+the\s+public\s+domain | domain
LicenseRef-all-rights-reserved | all\s+rights\s+reserved | reserved
LicenseRef-proprietary | proprietary\s+and\s+confidential | proprietary
LicenseRef-copyright | (?:copyright|\(c\))\s*(?:\(c\)|©)?\s*(?:19|20)\d\d(?:\s*[-,]\s*(?:19|20)\d\d)* | copyright;(c)
GPL-2.0 | (?<![\w-])gpl[\s-]*v?2(?:\.0)?(?:\+|(?![\w.]*\w)) | gpl
GPL-3.0 | (?<![\w-])gpl[\s-]*v?3(?:\.0)?(?:\+|(?![\w.]*\w)) | gpl
LGPL-2.1 | (?<![\w-])lgpl[\s-]*v?2\.1\+? | lgpl
LGPL-3.0 | (?<![\w-])lgpl[\s-]*v?3(?:\.0)?\+? | lgpl
AGPL-3.0 | (?<![\w-])agpl[\s-]*v?3(?:\.0)?\+? | agpl
"""
_UNDER = r"(?:(?:this\s+(?:work|software|project|file|program|code)\s+is\s+)?(?:dual[\s-])?(?:licen[cs]ed|released|distributed|available|provided|published|covered|governed)\s+(?:under|by)\s+)(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+|a\s+|an\s+)?"

TAG, NOTICE, ADDRESS, NAME = 4, 3, 2, 1


@dataclass(frozen=True)
class Rule:
    name: str
    license: str
    pattern: str
    gates: tuple[tuple[str, ...], ...]
    priority: int
    regex: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "regex", re.compile(self.pattern, re.IGNORECASE | re.ASCII))


def _gates(x: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(g.split(",")) for g in x.split(";"))


@cache
def rules() -> tuple[Rule, ...]:
    out = []

    def add(kind: str, spdx: str, pattern: str, gates: tuple[tuple[str, ...], ...], priority: int) -> None:
        out.append(Rule(f"{kind}:{spdx}:{len(out)}", spdx, pattern, gates, priority))

    def family(spdx: str, name: str, gates: tuple[tuple[str, ...], ...], address: str) -> None:
        add("tag", spdx, rf"spdx-license-identifier:\s*{re.escape(spdx)}(?:-only|-or-later|\+)?(?![\w.-]*\w)", (("spdx",),), TAG)
        add("notice", spdx, rf"{_UNDER}(?<!\w){name}", gates, NOTICE)
        add("address", spdx, rf"(?:https?:)?//(?:www\.)?(?:{address})", (("//",),), ADDRESS)
        add("name", spdx, rf"(?<!\w){name}", gates, NAME)

    for line in _LICENSES.strip().splitlines():
        spdx, name, gates, address = (x.strip() for x in line.split(" | "))
        family(spdx, name, _gates(gates), address.removeprefix(r"www\."))
    for kind, words in _COMMONS.items():
        flat = kind.replace("-", r"[\s-]")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = version.replace(".", r"\.")
            name = rf"(?:cc[\s-]{flat}|creative\s+commons\s+{words})(?:\s+(?:international|unported|generic|{L}))*{V}{v}"
            family(f"CC-{kind}-{version}", name, ((version,),), rf"creativecommons\.org/licenses/{kind.lower()}/{v}")
    for line in _NOTICES.strip().splitlines():
        spdx, text, gates = (x.strip() for x in line.split(" | "))
        add("text", spdx, text, _gates(gates), NOTICE)
    return tuple(out)


@cache
def _literals() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in {x for r in rules() for g in r.gates for x in g}:
        found.add_word(x, x)
    found.make_automaton()
    return found


def settle(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the detections that lie inside none of better rank, in order."""
    every = rules()
    ranked = sorted(found, key=lambda x: (-every[x[2]].priority, x[0] - x[1], x[0], x[2]))
    starts = sorted({x[0] for x in found})
    seat = {s: i + 1 for i, s in enumerate(starts)}
    tree = [0] * (len(starts) + 1)  # the largest end among better ones that start no later

    kept = []
    for start, end, rule in ranked:
        i, reach = seat[start], 0
        while i:
            reach = max(reach, tree[i])
            i &= i - 1
        if reach < end:
            kept.append((start, end, rule))
        i = seat[start]
        while i < len(tree):
            tree[i] = max(tree[i], end)
            i += i & -i
    return sorted(kept)


def detect(text: str) -> list[tuple[int, int, int]]:
    """Settled detections of one text."""
    have = {x for _, x in _literals().iter(text.lower())}
    found = [(m.start(), m.end(), i) for i, r in enumerate(rules()) if any(map(have.issuperset, r.gates)) for m in r.regex.finditer(text)]
    return settle(found) if len(found) > 1 else found


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("rule", pa.string()), ("priority", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gates = sorted({g[0] for r in rules() for g in r.gates})
    gates = [g for g in gates if not any(o != g and o in g for o in gates)]
    every = rules()
    for batch in batches:
        text = batch.column("text")
        lower = pc.utf8_lower(text)
        maybe = np.zeros(len(text), bool)
        for g in gates:
            maybe |= pc.match_substring(lower, g).fill_null(False).to_numpy(zero_copy_only=False)
        out = []
        at = np.flatnonzero(maybe)
        for doc, x in zip(batch.column("doc_id").take(pa.array(at)).to_pylist(), text.take(pa.array(at)).to_pylist()):
            out += [(doc, s, e, every[r].license, every[r].name, every[r].priority) for s, e, r in detect(x)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _FOUND)] if out else [pa.array([], f.type) for f in _FOUND], schema=_FOUND)


def detections(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, license, rule, priority) of all settled detections."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_scan), "doc_id long, start int, end int, license string, rule string, priority int")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return detections(table(spark, sf_dir, "documents"))
