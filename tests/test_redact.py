import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import redact as r

L = "<redacted:secret>"
CASES = [
    ("enable secret 5 $1$abc$xyz", f"enable secret 5 {L}"),
    ("enable password level 15 7 0822455D0A16", f"enable password level 15 7 {L}"),
    ("username bob password 7 0822455D", f"username bob password 7 {L}"),
    ("username amy privilege 15 view root secret cleartext", f"username amy privilege 15 view root secret {L}"),
    ("set password ENC AbCdEf==", f"set password ENC {L}"),
    ("snmp-server community s3cr3t RO 10", f"snmp-server community {L} RO 10"),
    ("snmp-server community public RO", "snmp-server community public RO"),
    ("snmp-server host 10.0.0.1 vrf M traps version 2c s3cr3t udp", f"snmp-server host 10.0.0.1 vrf M traps version 2c {L} udp"),
    ("snmp-server host 10.0.0.1 version 3 priv bob", "snmp-server host 10.0.0.1 version 3 priv bob"),
    ("snmp-server user u GRP v3 auth sha AAA priv aes 128 BBB", f"snmp-server user u GRP v3 auth sha {L} priv aes 128 {L}"),
    ("radius-server host 10.0.0.1 auth-port 1812 key 7 9999abc", f"radius-server host 10.0.0.1 auth-port 1812 key 7 {L}"),
    (" password 7 0822455D", f" password 7 {L}"),
    (" password encryption aes", " password encryption aes"),
    ("password-policy min 8", "password-policy min 8"),
    (" key 1", " key 1"),
    (" key MySharedSecret", f" key {L}"),
    (" key-string 0 TheSecret", f" key-string 0 {L}"),
    ("ip ospf message-digest-key 1 md5 7 abc", f"ip ospf message-digest-key 1 md5 7 {L}"),
    ("ntp authentication-key 1 md5 abc 7", f"ntp authentication-key 1 md5 {L} 7"),
    (" neighbor 10.0.0.2 password 7 02050D48", f" neighbor 10.0.0.2 password 7 {L}"),
    ("phash $5$salt$digest", f"phash $5${L}"),
    ("set psksecret hunter2", f"set psksecret {L}"),
    ("interface Loopback0", "interface Loopback0"),
    ("", ""),
]


@pytest.mark.parametrize("whole", [False, True])
def test_credentials_go_and_the_rest_stays(spark, whole):
    text = ["\n".join(a for a, _ in CASES)] if whole else [a for a, _ in CASES]
    want = ["\n".join(b for _, b in CASES)] if whole else [b for _, b in CASES]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string")
    once = r.redact(F.col("t"), r.CREDENTIALS)
    got = sorted(rows.select("i", once.alias("a"), r.redact(once, r.CREDENTIALS).alias("b")).collect())
    for g, w in zip(got, want, strict=True):
        assert g.a == w and g.b == w
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(r.redact(F.col("t"), r.CREDENTIALS).alias("a")).first().a is None


def test_what_a_rule_needs_changes_no_result(spark):
    from pyspark.sql import functions as F

    from ledgerlake.operators.redact import RULES, redact

    texts = ["", "plain", "a@b.cd", "a@", 'token = "x y"', 'token = ""', "9" * 12, "9" * 20, 'secret = "a@b.cd" 123456789012 x_y@z', "@ = \""]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert any(len(r) == 3 for r in RULES)
    found = rows.select(redact(F.col("t")).alias("a"), redact(F.col("t"), tuple(r[:2] for r in RULES)).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found]
