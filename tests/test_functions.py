import hashlib
import hmac

from pyspark.sql import functions as F

from sentinela import functions as fn


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, "\t a b \n", fn.strip) == "a b"
    assert one(spark, "123456789", lambda c: fn.zfill(c, 8)) == "123456789"
    assert one(spark, "12", lambda c: fn.zfill(c, 8)) == "00000012"
    assert one(spark, None, fn.digits) is None
    assert str(one(spark, "1000,50", fn.decimal_comma)) == "1000.50"
    assert one(spark, "1,2,3", fn.decimal_comma) is None
    assert str(one(spark, " 01/09/2022", lambda c: fn.day(c, "dd/MM/yyyy"))) == "2022-09-01"
    assert one(spark, "x", fn.day) is None


def test_documents(spark):
    assert one(spark, "11.222.333/0001-81", fn.cnpj_valid) is True
    assert one(spark, "11.222.333/0001-82", fn.cnpj_valid) is False
    assert one(spark, "00000000000000", fn.cnpj_valid) is False
    assert one(spark, "529.982.247-25", fn.cpf_valid) is True
    assert one(spark, None, fn.cpf_valid) is False
    assert one(spark, "11222333000181", fn.cnpj_format) == "11.222.333/0001-81"
    assert one(spark, "52998224725", fn.cpf_mask) == "***.982.247-**"
    assert one(spark, "***.222.333-**", fn.visible_digits) == one(spark, "***222333**", fn.visible_digits) == "222333"
    assert one(spark, "123", fn.visible_digits) is None


def test_hmac(spark):
    for key in ("salt", "k" * 70):
        assert one(spark, "ação", lambda c, k=key: fn.hmac_hex(c, k)) == hmac.new(key.encode(), "ação".encode(), hashlib.sha256).hexdigest()


def test_address_and_category(spark):
    assert one(spark, "Rua A, 12", fn.address_key) == "RUA A|12"
    assert one(spark, "123", fn.address_key) == "|123"
    assert one(spark, "Rua A", fn.address_key) is None
    assert one(spark, "Aquisicao de SOFTWARE e obra", fn.object_category) == "TECNOLOGIA"
    assert one(spark, "nada", fn.object_category) is None
