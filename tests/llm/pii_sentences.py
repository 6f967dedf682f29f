"""Sentences written by hand, in no table and none of the training carriers; details in braces with the first letter of their kind."""

SENTENCES = """
Yesterday {n:Priya Raman} and {n:Tom Becker} waited in the lobby for an hour.
The receipt was issued to {n:Gregory Hale}, who never got it.
Could {n:Dave} ring me on {p:+1 (415) 555-0137} tonight?
Contact {e:jane.roe@acme.example} before you ship it.
We moved from {a:14 Harbour View Road} to {a:Flat 3, 22 Elm Grove} in spring.
Her passport {i:K1234567} was copied at the counter.
The form asks for a social security number, mine is {i:123-45-6789}.
{n:Martin Oyelaran} has paid already, see invoice INV-2024-00312.
I handed the keys to {n:Mrs. Patel}.
Let {n:Rosalind Achterberg} know that the parcel is at {a:9 Chestnut Lane}.
You may also write to {e:billing+west@northwind.org} or phone {p:020 7946 0018}.
My brother {n:Callum} lives at {a:118 Station Road, Unit 4} now.
Please correct the spelling, it is {n:Siân Llewellyn} and not Sean.
It was {n:Dr. Okonkwo} who wrote the report on 3 May.
The driver left his number: {p:07911 123456}.
National insurance {i:QQ 12 34 56 C} is on the letter.
Wire the refund to {n:Helena Vasquez}, not to the old account.
After 18:00 call {n:Bob Fletcher} at {p:(212) 555-0199}.
Someone named {n:Yusuf Demir} picked it up from {a:77 Mill Street}.
Regards, {n:Oluwadamilola Bakare}
The agent gave her name as {n:Noemi Szabo} and hung up.
Is {e:first.last@mail.example.net} still the right address?
His Emirates ID is {i:784-1990-1234567-1}.
Tell {n:Frank} the oven is fixed.
Deliver to {a:Villa 12, Street 8} after noon.
Order BK-7700123 was cancelled and tracking 174455667788 shows nothing.
The meter reads 004512 and the bill says 312 AED.
Batch 455-120-9981 tastes of soap.
We asked for 12 rolls and got 9.
Error E-40412 appears when the pump starts.
Ich heiße {n:Annegret Pohlmann} und warte seit Tagen.
Schicken Sie es bitte in die {a:Lindenstraße 48}.
Herr {n:Tobias Kranz} hat die Rechnung bezahlt.
Meine Handynummer lautet {p:+49 171 2345678}.
Meu nome é {n:Rafaela Teixeira} e o pedido não chegou.
A encomenda ficou na {a:Rua das Acácias 27}.
Ligue para {p:+351 912 345 678} depois das seis.
Me atendió {n:Ramiro Quintana} y fue amable.
Vivo en la {a:Calle de la Luna 16} desde enero.
Mi correo es {e:ramiro.q@correo.example}.
Je voudrais parler à {n:Mathilde Roussel}.
Le livreur cherche le {a:31 rue du Vieux Port}.
Mon portable est le {p:+33 6 12 34 56 78}.
الطلب باسم {n:خالد المنصوري} ولم يصل.
رقم جوالي {p:+971 50 123 4567} للتواصل.
أرسلوا الفاتورة إلى {e:khalid@bareed.example} اليوم.
मेरी बहन {n:कविता शर्मा} ने ऑर्डर किया था।
मेरा फ़ोन {p:98765 43210} है।
میری بہن {n:نادیہ قریشی} نے آرڈر دیا تھا۔
میرا نمبر {p:0300-1234567} ہے۔
"""
_KINDS = {"n": "name", "p": "phone", "e": "email", "a": "address", "i": "id_number"}


def sentences():
    """(text, spans) of every sentence; titles are no part of a name."""
    import re

    for line in SENTENCES.strip().splitlines():
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w):([^}]*)\}", line):
            text += line[at : m.start()]
            title = re.match(r"(?:Mrs|Mr|Dr)\. ", m.group(2))
            spans.append((len(text) + (title.end() if title else 0), len(text) + len(m.group(2)), _KINDS[m.group(1)]))
            text += m.group(2)
            at = m.end()
        yield text + line[at:], spans
