"""The stemmer against published pairs, and the indexed stems of a table against the terms one by one."""

import re
from collections import Counter

import pytest

from slatework.functions.english import STOP_WORDS, english, stem
from slatework.plans.config import SearchConfig
from slatework.plans.queries_search import CATALOGUE

PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die generate generat generic generic general general communication communic parsing pars parse pars parser parser hopping hop hoping hope cries cri ties tie gas gas this this bias bias happy happi say say by by
succeed succeed outings outing caresses caress agreed agre feed feed formalize formal electrical electr hopeful hope goodness good adjustment adjust adoption adopt rational ration""".split()


def test_published_pairs():
    assert [(w, stem(w)) for w in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2]))
    assert english("the") is None and english("parsing") == "pars" and stem("naïvely") == "naïvely" and stem("x2s") == "x2s" and stem("") == ""
    assert len(STOP_WORDS) == 127
    with pytest.raises(ValueError):
        SearchConfig(analysis="latin")


def test_stems_of_a_table(spark, sf):
    df, cf = Counter(), Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        found = [s for t in re.findall(r"\w+", (r.text or "").lower()) if (s := english(t)) is not None]
        cf.update(found)
        df.update(set(found))
    got = {r.term: (r.df, r.cf) for r in CATALOGUE.queries["index_english_statistics"](spark, sf).collect()}
    assert got == {t: (df[t], cf[t]) for t in cf}
