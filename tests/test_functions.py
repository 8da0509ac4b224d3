import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.functions import accounts, fingerprint, names, parsing, text


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


GUID = "0a1b2c3d-4e5f-6789-abcd-ef0123456789"
MESSAGES = {
    "took 17 of 400 retries": "took N of N retries",
    f"no room {GUID} beside {GUID.upper()}": "no room UUID beside UUID",
    f"x{GUID} stays, {GUID}0 too": "x0a1b2c3d-4e5f-N-abcd-ef0123456789 stays, 0a1b2c3d-4e5f-N-abcd-ef01234567890 too",
    "peer 8.8.4.4 left for 300.1.2.3": "peer IP left for IP",
    "v1.2.3.4.5": "v1.IP",
    "from 2031-11-30T23:59:58Z to 2031-12-01 00:00:01.25-05:30": "from TIMESTAMP to TIMESTAMP",
    "2031-1-2T3:4:5": "N-N-2T3:N:N",
    "wrote /srv/data/maps/level.bin": "wrote PATH/level.bin",
    "wrote D:\\saves\\slot\\one.sav": "wrote PATH/one.sav",
    "either/or": "eitherPATH/or",
    "a//b/": "a/PATH/b/",
    "ends in /": "ends in /",
    "ratio 3/4": "ratio 3PATH/N",
    "see http://host.example/a/b?c=1": "see http:/PATH/b?c=N",
    "/var/cash$1.log": "PATH/cash$N.log",
    "player_7 beats player_x and player_88": "player_N beats player_x and player_N",
    "multiplayer_7": "multiplayer_7",
    "item_bow_3 item_long_bow_3 item_9": "item_bow_N item_long_bow_3 item_9",
    "object @beef12 and @zz": "object @ADDR and @zz",
    "스테이지7 시작": "스테이지7 시작",
    "10ms 10 ms": "10ms N ms",
    "": "",
}


def test_messages(spark):
    assert values(spark, text.normalize_message, [*MESSAGES, None]) == [*MESSAGES.values(), None]


def plain_paths(line: str) -> str:
    """By hand, character by character: a drive or a slash, folders, and a name."""
    bad, out, i = set('\\/:*?"<>|\r\n'), [], 0
    while i < len(line):
        at = i + 1 if line[i] == "/" else i + 3 if line[i : i + 1].isascii() and line[i : i + 1].isalpha() and line[i + 1 : i + 3] == ":\\" else None
        if at is None or at >= len(line) or line[at] in bad:
            out.append(line[i])
            i += 1
            continue
        while True:
            end = at
            while end < len(line) and line[end] not in bad:
                end += 1
            if end + 1 < len(line) and line[end] in "\\/" and line[end + 1] not in bad:
                at = end + 1
            else:
                break
        out.append("PATH/" + line[at:end])
        i = end
    return "".join(out)


def test_paths_against_a_plain_reading(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choice("ab /\\:C|\n") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    assert values(spark, text.mask_paths, lines) == [plain_paths(x) for x in lines]


def test_a_line_of_a_million_slashes(spark):
    many = "either/or " * 1_000_000
    masked, folders, newlines = values(spark, text.normalize_message, [many, "/a" * 1_000_000, "\n" * 1_000_000])
    assert masked == "eitherPATH/or " and folders == "PATH/a" and newlines == "\n" * 1_000_000
    assert values(spark, text.only_newlines, ["\r\n" * 500_000, "\n\r", "\nx", "", None]) == [True, True, False, False, False]


FRAMES = {
    "at com.studio.world.Loader.open(Loader.java:318)": ["com.studio.world.Loader.open(Loader.java:310)"],
    "at com.studio.world.Loader.open(Loader.java:9)": ["com.studio.world.Loader.open(Loader.java:0)"],
    "   at com.studio.world.Loader.open(Loader.java:1000)  ": ["com.studio.world.Loader.open(Loader.java:1000)"],
    "at com.game.net.Poll.$lambda$17(Poll.java:61)": ["com.game.net.Poll.$lambda(Poll.java:60)"],
    "at com.game.net.Poll.lambda$run$4(Poll.java:61)": ["com.game.net.Poll.lambda$run$4(Poll.java:60)"],
    "at app//com.game.net.Poll.run(Poll.java:61)": [],
    "at io.netty.a.B.c(B.java:1)\nat kotlin.D.e(D.kt:2)\nat reactor.F.g(F.java:3)": [],
    "at com.game.Sound.play(Unknown Source)": ["com.game.Sound.play(Unknown Source)"],
    "at com.gamecompany.Shop.buy(Shop.java:77777777777)": ["com.gamecompany.Shop.buy(Shop.java)"],
    "at com.game.Outer$Inner.call(Outer.java:8)": [],
    "at com.game.X.<init>(X.java:25)\nnoise\nat com.studio.Y.z(Y.java)": ["com.game.X.<init>(X.java:20)", "com.studio.Y.z(Y.java)"],
    "nothing at all": [],
    "": [],
}


def test_frames(spark):
    assert values(spark, fingerprint.app_frames, [*FRAMES, None]) == [*FRAMES.values(), []]


def frames(*calls):
    return "".join(f"\nat com.{c}" for c in calls)


TIERS = {
    "q.E: why" + frames("game.P.a(P.java:11)", "studio.Q.b(Q.java:22)", "game.R.c(R.java:33)"): "HIGH",
    "q.E: why" + frames("game.P.a(P.java:11)", "elsewhere.Q.b(Q.java:22)"): "MEDIUM",
    "no.dots.Fault: the door is shut": "LOW",
    "x.y:": "LOW",
    "the door is shut": "VERY_LOW",
    "Fault: no dot before the colon": "VERY_LOW",
    " \t\nat org.other.A.b(A.java:1)": "FALLBACK",
    "": "FALLBACK",
}


def test_tiers(spark):
    of = lambda c: fingerprint.issue_fingerprint(c, F.lit("WARN"), F.lit("QUEST"))
    assert values(spark, lambda c: of(c)["quality"], TIERS) == list(TIERS.values())
    hashed = {"no.dots.Fault: door 12 is shut": "no.dots.Fault\ndoor N is shut", "door 12 is shut": "door N is shut", "": "WARN_QUEST", "q.E: y\nat com.game.P.a(P.java:19)": "q.E\ncom.game.P.a(P.java:10)\n"}
    assert values(spark, lambda c: of(c)["fingerprint"], hashed) == [hashlib.sha256(t.encode()).hexdigest() for t in hashed.values()]
    assert values(spark, lambda c: of(c)["strategy"], ["", "x"]) == ["Fallback (Severity + Category)", "Message Only"]


def test_lines_in_one_bucket_share_a_fingerprint(spark):
    lines = ["q.E: why" + frames(f"game.P.a(P.java:{n})") for n in (70, 73, 79, 80)]
    a, b, c, d = values(spark, lambda x: fingerprint.issue_fingerprint(x, F.lit("WARN"), F.lit("QUEST"))["fingerprint"], lines)
    assert a == b == c != d


def test_log_and_issue_fingerprints_differ_in_the_last_tier_only(spark):
    logs = values(spark, lambda c: fingerprint.log_fingerprint(c, F.lit("INFO"))["fingerprint"], ["", "x"])
    issues = values(spark, lambda c: fingerprint.issue_fingerprint(c, F.lit("INFO"), F.lit("SYSTEM"))["fingerprint"], ["", "x"])
    assert logs[0] != issues[0] and logs[1] == issues[1]


def test_titles(spark):
    long = "z" * 501
    assert values(spark, text.issue_title, [None, "", "\t head \nbody", long, "z" * 500]) == ["Unknown Error", "Unknown Error", "head", "z" * 497 + "...", "z" * 500]


@pytest.mark.parametrize("function, inputs, expected", [
    (parsing.parse_severity, [None, "\n", "debug", " Fatal\t", "severe"], ["INFO", "INFO", "DEBUG", "FATAL", None]),
    (parsing.parse_category, [None, "", "quest", " 전투 ", "전투!"], ["SYSTEM", "SYSTEM", "QUEST", "COMBAT", None]),
    (parsing.parse_status, [None, "Resolved", " open", "closed?"], ["OPEN", "RESOLVED", "OPEN", "OPEN"]),
    (parsing.parse_uuid, [GUID.upper(), "2-3-4-5-6", None], [GUID, None, None]),
    (parsing.parse_json_object, [None, '{"k": [2]}', "[2]", "{k", "true"], ["{}", '{"k": [2]}', None, None, None]),
    (names.file_extension, ["report.final.png", "v2.d/plan", "plan", ".env"], ["png", None, None, "env"]),
    (names.file_stem, ["report.final.png", "v2.d/plan", "plan"], ["report.final", "v2.d/plan", "plan"]),
    (names.content_type, ["PNG", "jpg", None, "zip"], ["image/png", "image/jpeg", "application/octet-stream", "application/octet-stream"]),
    (accounts.display_name, [None, "\t", "lee"], ["사용자", "사용자", "lee"]),
    (accounts.grantable_role, ["Admin", "Ceo", "intern", None], ["EMPLOYEE", "CEO", "EMPLOYEE", "EMPLOYEE"]),
])
def test_small_functions(spark, function, inputs, expected):
    assert values(spark, function, inputs) == expected


def test_times(spark):
    default = F.lit("1999-12-31 00:00:00").cast("timestamp")
    inputs = ["2030-07-01T08:30:00-02:00", "2030-07-01T08:30:00.75Z", "2030-07-01 08:30:00", "2030-07-01", None, "2030-02-30T08:30:00Z"]
    found = values(spark, lambda c: F.date_format(parsing.parse_time(c, default), "yyyy-MM-dd HH:mm:ss"), inputs)
    assert found == ["2030-07-01 10:30:00", "2030-07-01 08:30:00", *["1999-12-31 00:00:00"] * 4]


def test_patterns_look_for_what_a_match_begins_with():
    """Each look ahead is implied by the pattern behind it, so it changes no match."""
    for pattern, sample in ((text.UUID, GUID), (text.IPV4, "1.2.3.4"), (text.PLAYER, "player_1"), (text.ITEM, "item_a_1"), (text.NUMBER, "1")):
        ahead = re.match(r"\(\?=(.*?)\)\(\?<!", pattern)[1]
        assert re.match(ahead, sample)


def test_the_short_way_of_the_normaliser(spark):
    """Texts without what most steps look for take one step: they come out as by all of them."""
    parts = ["7", "a7", "10.0.0.1", "1.2.3", "2024-01-01T00:00:00", "550e8400-e29b-41d4-a716-446655440000", "/a/b 1", "c:\\d\\e", "@f0", "player_7", "item_a_7", "player7", "가7", " ", "", "12,5", "x_9"]
    texts = [(f"{a}{sep}{b}",) for a in parts for b in parts for sep in ("", " ", ":")] + [(None,)]
    every = F.col("t")
    for step in text.STEPS:
        every = step(every)
    rows = spark.createDataFrame(texts, "t string").select("t", text.normalize_message(F.col("t")).alias("got"), every.alias("want"))
    assert rows.where("NOT got <=> want").collect() == [] and rows.where("got != t").count() > 100
