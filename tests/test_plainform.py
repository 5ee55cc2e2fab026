from gridloom.functions.plainform import plain_form

CASES = {
    "２０１５년": "2015년", "물나군": "물나군", "Αdνanced Οverpass": "Advanced Overpass", "Россия α β": "Россия α β",
    "Zürich": "Zürich", "면적（㎡）": "면적(㎡)", "a​b­c": "abc", "a b　c\td": "a b c d", "a\r\nb c": "a\nb\nc", "가ㆍ나・다": "가·나·다",
    "𝐃𝐞𝐩𝐨𝐭 ﬁ": "Depot fi", "−1 ‑ ‐": "-1 - -", "㎢ ² ℃ … ①": "㎢ ² ℃ … ①", "⼈⽴ 金": "人立 金", "“가” “a”": "“가” “a”", "“a”": '"a"', "": "",
}


def test_cases():
    for text, want in CASES.items():
        assert plain_form(text) == want, (text, plain_form(text))
    assert plain_form(None) is None


def test_idempotent():
    for text in CASES:
        once = plain_form(text)
        assert plain_form(once) == once
