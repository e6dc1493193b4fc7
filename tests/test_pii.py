import pytest
from pyspark.sql import functions as F

from textloom.operators import pii as P

POSITIVE = [
    (P.EMAIL, "letters reach olga@harbour.test by noon", ["olga@harbour.test"]),
    (P.EMAIL, "vera@kv.test", ["vera@kv.test"]),
    (P.URL, "the map is at https://maps.harbour.org/x today", ["https://maps.harbour.org/x"]),
    (P.CREDIT_CARD, "paid with 4929 1103 8846 2075 at the quay", ["4929 1103 8846 2075"]),
    (P.US_SSN, "his number, 417-20-8835, was on file", ["417-20-8835"]),
    (P.US_PASSPORT, "she showed passport 508213947 there", ["508213947"]),
    (P.IBAN, "pay into GB82604011223344 soon", ["GB82604011223344"]),
    (P.US_ITIN, "filed under 912-74-3306 last year", ["912-74-3306"]),
    (P.CRYPTO, "Send BTC to 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2.", ["1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2"]),
    (P.US_BANK_NUMBER, "the account 730455128 is closed", ["730455128"]),
    (P.UK_NHS, "her record 485 777 3456 is old", ["485 777 3456"]),
    (P.ES_NIF, "firmado 40718225K ayer", ["40718225K"]),
    (P.IT_FISCAL_CODE, "intestato a BNCLRA75D52F205X oggi", ["BNCLRA75D52F205X"]),
    (P.SG_NRIC, "card S7719024H was found", ["S7719024H"]),
    (P.AU_ABN, "invoice of 83 914 571 673 here", ["83 914 571 673"]),
    (P.AU_TFN, "tax file 459 599 230 closed", ["459 599 230"]),
    (P.US_DRIVER_LICENSE, "licence D8052713 was lost", ["D8052713"]),
    (P.IP, "at 10.0.0.1 now", ["10.0.0.1"]),
    (P.PHONE_US, "ring 415-228-6173 or (212) 664-9035 tonight", ["415-228-6173", "(212) 664-9035"]),
    (P.PHONE_UK, "try 07911 123904, then 020 7183 8750 and +44 1482 305611", ["07911 123904", "020 7183 8750", "+44 1482 305611"]),
    (P.PHONE_DE, "erst 040 778215, dann +49 89 401577", ["040 778215", "+49 89 401577"]),
    (P.PHONE_FR, "le 04 91 55 18 30 ou le +33 5 56 79 20 41", ["04 91 55 18 30", "+33 5 56 79 20 41"]),
    (P.PHONE_BR, "ligue (21) 98046-3317 ou +55 31 97725-0648", ["(21) 98046-3317", "+55 31 97725-0648"]),
    (P.PHONE_AU, "by day 03 9417 2260, else +61 7 3852 9914", ["03 9417 2260", "+61 7 3852 9914"]),
    (P.PHONE_IN, "dial +91 90284 17756", ["+91 90284 17756"]),
    (P.PHONE_CN, "dial +86 139 2071 6648", ["+86 139 2071 6648"]),
]
NEGATIVE = [(P.US_SSN, "417-208-835"), (P.IBAN, "GB826040112233"), (P.CREDIT_CARD, "4929 1103 8846"), (P.CRYPTO, "1BvBMSEYstWetqTFn5Au4m4GF"), (P.EMAIL, "a@b"), (P.US_ITIN, "417-20-8835"), (P.PHONE_US, "41-228-6173")]


def test_each_recognizer_finds_its_kind(spark):
    for recognizer, text, want in [*POSITIVE, *[(r, t, []) for r, t in NEGATIVE]]:
        found = P.Analyzer("en", [recognizer]).analyze(spark.createDataFrame([(text,)], "text string")).first().findings
        assert [text[f.start : f.end + 1] for f in found] == want, (recognizer.entity_type, text)


def test_all_recognizers_together(spark):
    df = spark.createDataFrame([("olga@harbour.test has 417-20-8835 on her form",), (None,), ("",)], "text string")
    got = [sorted(f.entity_type for f in r.findings) for r in P.Analyzer().add_all().analyze(df).collect()]
    assert got == [["EMAIL_ADDRESS", "US_SSN"], [], []]


@pytest.mark.parametrize(
    ("text", "spans", "how", "want"),
    [
        ("write to olga@harbour.test", [(9, 25)], "mask", "write to *****************"),
        ("write to olga@harbour.test", [(9, 25)], "replace", "write to <EMAIL>"),
        ("write to olga@harbour.test", [(9, 25)], "redact", "write to "),
        ("olga@harbour.test or 228-6173", [(0, 16), (21, 28)], "mask", "***************** or ********"),
        ("abcdefghij", [(0, 5), (3, 8)], "mask", "******ghij"),
        ("abc", [(1, 9), (-1, 0), (2, 1)], "mask", "abc"),
        ("abc", [(1, 1)], "hash", "a3e23e8160039594a33894f6564e1b1348bbd7a0088d42c4acb73eeaed59c009dc"),
    ],
)
def test_anonymize(spark, text, spans, how, want):
    df = spark.createDataFrame([(text, [(a, b, "X", 1.0) for a, b in spans])], "text string, findings array<struct<start:int,end:int,entity_type:string,score:float>>")
    assert df.select(P.anonymize(F.col("text"), F.col("findings"), how, replacement="<EMAIL>").alias("x")).first().x == want


def test_cloak_and_back(spark):
    first = "Crew: Olga Brandt, who reads olga@harbour.test daily"
    rows = [(1, first, [(6, 16, "PERSON", 1.0), (29, 45, "EMAIL", 1.0)]), (2, "Ahoy Olga Brandt!", [(5, 15, "PERSON", 1.0)]), (3, "no one", []), (4, "Ida and Olga Brandt", [(0, 2, "PERSON", 1.0), (8, 18, "PERSON", 1.0)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, findings array<struct<start:int,end:int,entity_type:string,score:float>>")
    got = {r.doc_id: r for r in P.cloak(df).withColumn("back", P.rehydrate(F.col("cloaked"), F.col("mapping"))).collect()}
    assert got[1].cloaked == "Crew: PERSON_1, who reads EMAIL_1 daily"
    assert got[2].cloaked == "Ahoy PERSON_1!" and got[3].cloaked == "no one" and got[4].cloaked == "PERSON_2 and PERSON_1"
    assert all(got[i].back == t for i, t, _ in rows)
