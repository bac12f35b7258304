"""Facts of prose against sentences labelled by hand, and page fields of odd markup."""

from listaro.operators import facts as T
from listaro.operators import parsing as P


def check(spark, rule, cases):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", rule(P.F.col("t")).alias("x")).collect()}
    assert [(text, got[i]) for i, (text, _) in enumerate(cases)] == cases


def test_certificates(spark):
    check(spark, T.certificate, [
        (None, None), ("", None), ("Boligen har ny takstein.", None),
        ("Kommunen har gitt ferdigattest for huset i 1994.", "ferdigattest"),
        ("Ferdigattest for tilbygget er datert 03.04.2011 og ligger i arkivet.", "ferdigattest"),
        ("Garasjen mangler ferdigattest.", "ingen"), ("Det er aldri søkt om ferdigattest for loftet.", "ingen"),
        ("Vi kjenner ingen ferdigattest.\nEgen inngang.", "ingen"), ("Huset er tatt i bruk uten at ferdigattest er gitt.", "ingen"),
        ("Ferdigattest foreligger ikke. Det er gitt midlertidig brukstillatelse i 2019.", "midlertidig"),
        ("Midlertidig brukstillatelse fra 2003.", "midlertidig"),
        ("Badet er ikke fornyet. Ferdigattest er utstedt 01.02.2003.", "ferdigattest"),  # the denial is another sentence's
        ("For bygg fra før 1998 utstedes det ikke lenger ferdigattest, jf. loven. Boligen er fra 1960.", "ferdigattest"),  # law in general
        ("Se avsnitt om ferdigattest/midlertidig brukstillatelse.", "ferdigattest"),  # only named
        ("Kjøper overtar enten ferdigattest foreligger eller ikke.", "ferdigattest"),
        ("En ferdigattest er ingen garanti mot feil.", "ferdigattest"),
        ("FERDIGATTEST: JA", "ferdigattest"),
    ])


def test_rental_and_pets(spark):
    check(spark, T.rental, [
        (None, None), ("Fin hage.", None), ("Huset har egen hybel med bad.", "egen_enhet"), ("Stor utleiedel i sokkel.", "egen_enhet"), ("Utleie er tillatt.", "tillatt"), ("Loftet kan leies ut.", "tillatt"),
        ("Det er ikke anledning til å leie ut boligen.", "ikke_tillatt"), ("Det er ikke lov å drive utleie her.", "ikke_tillatt"), ("Det er ikke tillatt å røyke. Boligen kan leies ut.", "tillatt"),
    ])
    check(spark, T.pets, [
        (None, None), ("Fin hage.", None), ("Husdyr er tillatt.", "tillatt"), ("Dyrehold ikke tillatt.", "ikke_tillatt"), ("Det er forbud mot dyrehold.", "ikke_tillatt"),
        ("Dyrehold krever søknad.", "krever_godkjenning"), ("Husdyr er ikke tillatt uten at styret samtykker.", "krever_godkjenning"), ("Katter er tillatt.", None), ("Styret møtes ofte. Husdyr er tillatt.", "tillatt"),
    ])


def test_fields_of_odd_pages(spark):
    pages = [
        ("none", None, None), ("empty", "u", ""), ("text", "u", "no markup at all"), ("broken", "u", "<div data-testid=info-usable-area>12 m²<span"),
        ("unclosed", "u", '<div data-testid="info-usable-area"><div>BRA</div>71 m²<p>more'), ("twice", "u", "<div data-testid='info-open-area'>x</div><div data-testid='info-open-area'>5 m²</div>"),
        ("nested", "u", '<div data-testid="pricing-total-price"><div><div>1</div></div>2 000 kr</div><div>9 000 kr</div>'),
    ]
    frame = spark.createDataFrame(pages, "id string, url string, html string")
    got = {r.id: r for r in P.listing_fields(frame).collect()}
    for name in ("none", "empty", "text"):
        assert (got[name].status, got[name].address, got[name].postcode, got[name].price, got[name].bra, got[name].image_url, got[name].kind) == (None, None, None, None, "", "", "")
    assert (got["broken"].bra, got["unclosed"].bra, got["twice"].tba, got["nested"].price) == ("12", "71", "", 12000)
    details = {r.id: r for r in P.detail_fields(frame).collect()}
    assert all(r.facilities == [] and r.totalpris is None and r.eieform is None and r.energimerke is None and r.rooms is None for r in details.values())
