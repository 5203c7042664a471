import base64
import quopri

from linkspark.llm import mail

BODY = "Wir haben den alten Katalog noch einmal geprüft und das Gerät nicht gefunden. Bitte vergessen Sie nicht, ihn zurückzugeben."


def message(part, head=""):
    return f"From: a@b.example\nSubject: x\n{head}MIME-Version: 1.0\n{part}"


def test_encodings_and_charsets():
    for charset in ("utf-8", "iso-8859-1", "windows-1252", "unknown-8bit", "us-ascii", "no-such-charset"):
        raw = BODY.encode("utf-8" if charset in ("utf-8", "no-such-charset") else "cp1252")
        b64 = base64.encodebytes(raw).decode()
        qp = quopri.encodestring(raw).decode()
        for encoding, text in (("base64", b64), ("quoted-printable", qp)):
            for end in ("\n", "\r\n"):
                m = message(f"Content-Type: text/plain; charset={charset}\nContent-Transfer-Encoding: {encoding}\n\n{text}").replace("\n", end)
                assert [p.text.strip() for p in mail.parts_of(m)] == [BODY]
                assert mail.parts_of(f"From x@y.example Fri Nov 29 15:10:27 2024{end}{m}")[0].text.strip() == BODY
    russian = "Насколько я вижу, номер не совпадает со списком."
    m = message("Content-Type: text/plain; charset=unknown-8bit\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(russian.encode("cp1251")).decode())
    assert mail.parts_of(m)[0].text == russian
    polish = "Było około sztuk, ale nikt nie zapisał, co się z nimi stało. Proszę nie zapomnieć."
    m = message("Content-Type: text/plain; charset=unknown-8bit\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(polish.encode("iso8859-2")).decode())
    assert mail.parts_of(m)[0].text == polish


def test_multiparts_markup_and_cuts():
    m = message('Content-Type: multipart/mixed; boundary="=_b"\n\nprologue\n--=_b\nContent-Type: text/html\n\n<p>One <b>tw</b>o &amp; three</p><div>Four<br>five</div><style>p {}</style>\n--=_b\nContent-Type: text/csv; name="x.csv"\nContent-Disposition: attachment\n\na;b\n--=_b\nContent-Type: image/png\n\nAAAA\n--=_b--\nepilogue')
    parts = mail.parts_of(m)
    assert [(p.kind, p.attached) for p in parts] == [("text/html", False), ("text/csv", True), ("image/png", False)]
    assert mail.words(mail.visible(parts[0])) == ["one", "two", "three", "four", "five"] and mail.words(mail.visible(parts[1])) == ["a", "b"]
    assert len(mail.parts_of(m[: m.index("--=_b--")])) == 3
    assert mail.parts_of("no headers at all") == [mail.Part("text/plain", False, "no headers at all")] and mail.parts_of("")[0].text == ""


def test_written_paragraphs():
    text = (
        "Guten Tag Alexander,\n\n" + BODY + "\n\nViele Grüße\nDorothy Purwoaflaby\n-- \nDorothy | d@x.example | +00\n\nThis mail passed the gateway of x.example. Views expressed bind nobody.\n\n"
        "On Thu, 18 Jan 2024 05:10:53 -0800, Edith <e@x.example> wrote:\n\n> As far as I can see, the booklet does not\nmatch the number on\n> the list.\n\n> Cheers\n> Edith\n\n"
        "-----Original Message-----\nFrom: Zoe <z@x.example>\nSent: Fri, 01 Sep 2023\nTo: Jon\nSubject: Re: it\n\nNous avons encore vérifié la facture, mais nous ne la trouvons toujours pas.\n"
    )
    assert mail.paragraphs(message("Content-Type: text/plain\n\n" + text))[0] == [BODY, "As far as I can see, the booklet does not match the number on the list.", "Nous avons encore vérifié la facture, mais nous ne la trouvons toujours pas."]


def test_paragraphs_with_addresses_are_kept_aside():
    body = "Bitte schicken Sie die Noten noch vor dem Wochenende an archiv@klang.example, denn dort werden sie gebraucht."
    kept, held = mail.paragraphs(message("Content-Type: text/plain\n\nHallo Anna,\n\n" + body + "\n\nFrom: A <a@b.example> Sent: Mon To: B <b@c.example> Subject: Re: x\n"))
    assert kept == [] and [h.address for h in held] == ["archiv@klang.example"] and "klang" not in held[0].text and held[0].text.startswith("Bitte schicken")


def test_deep_nesting_is_opened():
    text = "Content-Type: text/plain\n\nDer innerste Teil dieser Nachricht steht sehr tief.\n"
    for k in range(300):
        text = f"Content-Type: multipart/mixed; boundary=b{k}x\n\n--b{k}x\n{text}\n--b{k}x--\n"
    assert [p.text.strip() for p in mail.parts_of(text)] == ["Der innerste Teil dieser Nachricht steht sehr tief."]
