"""Character sets told apart on passages of three scripts, whole and cut."""

from __future__ import annotations

import random

from variorum.sources import charsets as C
from variorum.sources import files

TEXTS = {
    "simplified": "学而时习之，不亦说乎？有朋自远方来，不亦乐乎？人不知而不愠，不亦君子乎？其为人也孝弟，而好犯上者，鲜矣；不好犯上，而好作乱者，未之有也。君子务本，本立而道生。这个项目比较不同版本的文字，并且记录每一处差异，供研究人员参考使用。",
    "traditional": "學而時習之，不亦說乎？有朋自遠方來，不亦樂乎？人不知而不慍，不亦君子乎？如是我聞：一時，佛在舍衛國祇樹給孤獨園，與大比丘眾千二百五十人俱。爾時世尊食時，著衣持缽，入舍衛大城乞食。於其城中次第乞已，還至本處。",
    "japanese": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。吾輩はここで始めて人間というものを見た。",
}
SETS = {"simplified": ["gb18030", "utf-8", "utf-16-le", "utf-16-be"], "traditional": ["big5", "utf-8", "utf-16-le", "utf-16-be"], "japanese": ["shift_jis", "euc_jp", "utf-8", "utf-16-le", "utf-16-be"]}


def test_told_apart():
    r = random.Random(6)
    for script, text in TEXTS.items():
        for charset in SETS[script]:
            assert C.detect(text.encode(charset)) == (charset, text)
            right = 0
            for _ in range(200):
                size = r.randint(12, 60)
                at = r.randint(0, len(text) - size)
                part = text[at : at + size]
                right += (C.detect(part.encode(charset)) or ("", ""))[1] == part
            assert right >= 180, (script, charset, right)


def test_plain_cases():
    assert C.detect(b"") == ("utf-8", "") and C.detect(b"plain") == ("utf-8", "plain")
    assert C.detect("﻿甲乙".encode()) == ("utf-8-sig", "甲乙")
    for order in ("utf-16-le", "utf-16-be"):
        assert C.detect(("﻿" + "abc 甲").encode(order)) == ("utf-16", "abc 甲")
        assert C.detect("plain words only\r\n".encode(order)) == (order, "plain words only\r\n")
    assert C.detect("爾時世尊，告諸比丘。".encode("gbk")) == ("gb18030", "爾時世尊，告諸比丘。")
    assert C.detect(b"\xff\xff\xff") is None
    assert files._decode("學而時習之，不亦說乎？ ".encode("big5")) == "學而時習之，不亦說乎？" and files._decode(b"\xff\xff\xff") is None


def test_limits_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("學而時習之。".encode("big5"))
    (tmp_path / "b.txt").write_text("x" * 50, encoding="utf-8")
    told = lambda **limits: {r.name: (r.text, r.error) for r in files.witnesses(spark, str(tmp_path), **limits).collect()}
    both = {"a": ("學而時習之。", None), "b": ("x" * 50, None)}
    assert told() == told(most_bytes=None, most_chars=None) == both
    assert told(most_bytes=20) == {**both, "b": (None, "too large")}
    assert told(most_chars=20) == {**both, "b": (None, "too long")}
