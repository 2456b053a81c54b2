"""Language ID on the given documents: held-out accuracy, scores that vary, and what is rejected."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinela.llm import common, language

FOREIGN = {
    "it": "La casa era molto grande e il giardino pieno di fiori, ma nessuno voleva abitarci perché si diceva che fosse infestata da un vecchio fantasma.",
    "pl": "Wczoraj wieczorem poszliśmy do kina, a potem na kolację z przyjaciółmi, którzy właśnie wrócili z wakacji nad morzem.",
    "ru": "Вчера вечером мы пошли в кино, а потом на ужин с друзьями, которые только что вернулись из отпуска.",
    "zh": "昨天晚上我们去看电影，然后和刚刚度假回来的朋友一起吃晚饭。",
    "tr": "Dün akşam sinemaya gittik, sonra tatilden yeni dönen arkadaşlarımızla akşam yemeği yedik.",
    "fi": "Eilen illalla menimme elokuviin ja sitten illalliselle ystävien kanssa, jotka olivat juuri palanneet lomalta.",
    "none": "xqzv wkjh pplt zzrr mnbv qwpt zxcv kkjh bbrt xxpl",
}


@pytest.fixture(scope="module")
def model_and_docs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    return language.train(docs.filter(~common.held_out("doc_id", 0))), docs


def test_held_out_documents(model_and_docs):
    model, docs = model_and_docs
    got = language.predict(docs.filter(common.held_out("doc_id", 0)).filter("lang is not null and length(text) > 0"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.98
    assert np.mean([r.lang_rejected for r in got]) <= 0.01
    assert len({round(r.lang_score, 6) for r in got}) > len(got) / 4


def test_temperature_is_inside_its_grid(model_and_docs):
    assert 0.006 < model_and_docs[0].temperature < 45


def test_other_languages_are_rejected(spark, model_and_docs):
    docs = spark.createDataFrame(list(FOREIGN.items()), "name string, text string")
    got = {r.name: r.lang_rejected for r in language.predict(docs, model_and_docs[0]).collect()}
    assert all(got.values()), got


def test_known_documents_are_kept(model_and_docs):
    model, docs = model_and_docs
    got = language.predict(docs.filter("lang is not null").withColumn("n", F.length("text")).filter("n > 200"), model)
    assert got.filter("lang_rejected").count() <= 0.005 * docs.count()
