"""Hand-written texts with the personal data in them; none of their wording or numbers takes part in training."""

#: language, text, personal data in it (as written)
TEXTS = [
    ("en", "Hi Sam, my new cell is (617) 555-0142, the old one no longer works. See you on 12/05/2023!", ["(617) 555-0142"]),
    ("en", "For refunds ring 0800 496 0312 between 9:00 and 17:30, quoting ticket 20231177.", ["0800 496 0312"]),
    ("en", "You can write to margaret.hale (at) miltonmills (dot) org. She answers within a day.", ["margaret.hale (at) miltonmills (dot) org"]),
    ("en", "Her SSN 219-09-9999 was printed on page 14 of the 2019-2020 yearbook.", ["219-09-9999"]),
    ("en", "Kindly wire the deposit to GB29 NWBK 6016 1331 9268 19 before Friday.", ["GB29 NWBK 6016 1331 9268 19"]),
    ("en", "The library weighs 1 200 000 kg and holds 3 450 000 volumes since 1881.", []),
    ("en", "ISBN 978-0-306-40615-7, see section 4.12.2009 of release 10.4.0.1", []),
    ("en", "Contact: 212.555.0187 or 212.555.0199 after hours.", ["212.555.0187", "212.555.0199"]),
    ("en", "Order 4491823374 shipped on 2022-11-30 and arrived 2022-12-04.", []),
    ("en", "Text me on 00 44 7700 900123 when the part 8839-2210-44 is in stock.", ["00 44 7700 900123"]),
    ("en", "reach bob[at]harbour-cafe[dot]net for the table, total 48.50 for 12 guests", ["bob[at]harbour-cafe[dot]net"]),
    ("en", "Scores: 12 14 9 22 17 30 41 8. Average 19.1, record 2 345 678 points.", []),
    ("fr", "Vous pouvez me joindre au 06 39 98 12 07 ou au bureau 01.44.27.60.60.", ["06 39 98 12 07", "01.44.27.60.60"]),
    ("fr", "Facture 20230418 du 18.04.2023, montant 1 250 000 francs.", []),
    ("fr", "Mon courriel : claire.dumont (at) laposte (dot) fr. Merci beaucoup.", ["claire.dumont (at) laposte (dot) fr"]),
    ("fr", "Virement sur le compte FR76 3000 6000 0112 3456 7890 189 avant lundi.", ["FR76 3000 6000 0112 3456 7890 189"]),
    ("fr", "Le chantier a duré de 1998-2004 et coûté 12 345 678 euros.", []),
    ("fr", "Appelez ma soeur: (02) 35 71 22 14. Elle habite au 14 rue des Lilas.", ["(02) 35 71 22 14"]),
    ("fr", "La référence 7781-2290-4410 figure page 12, commande 99120045.", []),
    ("fr", "portable 0612345998, merci de ne pas appeler après 21 h", ["0612345998"]),
    ("de", "Meine Handynummer ist 0171 5550199, im Büro erreichen Sie mich unter 030/2093770.", ["0171 5550199", "030/2093770"]),
    ("de", "Rechnung 2023110045 vom 03.11.2023, fällig am 17.11.2023.", []),
    ("de", "Bitte an jonas.weber (at) posteo (dot) de schreiben, nicht anrufen.", ["jonas.weber (at) posteo (dot) de"]),
    ("de", "Konto DE89 3704 0044 0532 0130 00, Verwendungszweck Miete.", ["DE89 3704 0044 0532 0130 00"]),
    ("de", "Im Jahr 1989 hatte die Stadt 1 278 300 Einwohner, 2011 nur noch 1.150.200.", []),
    ("de", "Rufen Sie an: (089) 2180123, montags bis freitags 8.00-16.00 Uhr.", ["(089) 2180123"]),
    ("de", "Artikel 4711-0815-2020, Seite 233, Modell 7 4 1 1 0 2 9 3", []),
    ("de", "IBAN DE02120300000000202051 bei der Hausbank", ["DE02120300000000202051"]),
    ("es", "Mi número es 612 44 90 13, llámame por la tarde.", ["612 44 90 13"]),
    ("es", "Pedido 88213409 del 05/07/2022, factura 2022-0715.", []),
    ("es", "Escríbenos a lucia_perez [at] correo [dot] es o ven a la tienda.", ["lucia_perez [at] correo [dot] es"]),
    ("es", "La cuenta es ES91 2100 0418 4502 0005 1332 de la comunidad.", ["ES91 2100 0418 4502 0005 1332"]),
    ("es", "En 2015 se vendieron 1 345 900 libros, y 2 001 450 en 2016-2017.", []),
    ("es", "Teléfono fijo 915 550 123, fecha de alta 01.02.2003.", ["915 550 123"]),
    ("es", "El código 5512-8890 aparece en la página 321 del artículo 10.1000/182555.", []),
    ("es", "Contacto: 0034 913 445566 (recepción)", ["0034 913 445566"]),
]

#: A second set, written after the formats of training were settled and not used for settling them.
LATER = [
    ("en", "Leave word with Priya on 415-555-0136 if the parcel 77120-B is late.", ["415-555-0136"]),
    ("en", "He signs as tom_baxter [AT] quarry-lane [DOT] com on every forum.", ["tom_baxter [AT] quarry-lane [DOT] com"]),
    ("en", "The clinic moved; phone (0161) 496 0733 for the new hours, 8:30 to 16:45.", ["(0161) 496 0733"]),
    ("en", "Account GB82WEST12345698765432 was closed on 2020-03-14.", ["GB82WEST12345698765432"]),
    ("en", "Between 1914-1918 the mill made 3 200 500 blankets, see figure 12.4.", []),
    ("en", "Call us toll free: 1-800-555-0199. Mention invoice 2021-44871.", ["1-800-555-0199"]),
    ("en", "Build 20231104173 passed, version 4.18.2.77 failed after 300 seconds.", []),
    ("fr", "Vous pouvez appeler le 07 81 22 40 19 en soirée, jamais avant 18 h.", ["07 81 22 40 19"]),
    ("fr", "Écrivez à paul.morel (at) orange (dot) fr pour la commande 33019.", ["paul.morel (at) orange (dot) fr"]),
    ("fr", "Téléphone : 02-41-86-30-12, bâtiment C, page 4 du plan 1987-1991.", ["02-41-86-30-12"]),
    ("fr", "Mon compte FR14 2004 1010 0505 0001 3M02 606 reste ouvert jusqu'au 31/12/2024.", ["FR14 2004 1010 0505 0001 3M02 606"]),
    ("fr", "En 1999 la région comptait 2 345 678 habitants et 1 204 communes.", []),
    ("de", "Sie erreichen Frau Lenz unter 0341 9730123 oder mobil 0151-2345678.", ["0341 9730123", "0151-2345678"]),
    ("de", "Schreiben Sie an kontakt [at] buchladen-nord [dot] de, Betreff Bestellung 55210.", ["kontakt [at] buchladen-nord [dot] de"]),
    ("de", "Die Rechnungsnummer lautet 2022-0099123, Seite 3, Datum 09.09.2022.", []),
    ("de", "Bitte auf DE12 5001 0517 0648 4898 90 überweisen, danke!", ["DE12 5001 0517 0648 4898 90"]),
    ("de", "Das Werk von 1905 wog 12 450 000 Tonnen, Teil 88-1204-7.", []),
    ("es", "Mi móvil es 655 21 09 87 y el fijo 93 412 30 44.", ["655 21 09 87", "93 412 30 44"]),
    ("es", "Llámame al 699123456 cuando llegues a la estación.", ["699123456"]),
    ("es", "Correo: ana.ruiz(at)empresa.es, referencia 2019/4471.", ["ana.ruiz(at)empresa.es"]),
    ("es", "La cuenta ES7921000813610123456789 recibe las cuotas.", ["ES7921000813610123456789"]),
    ("es", "Se imprimieron 4 500 300 ejemplares entre 2001 y 2005, artículo 77/2003/12.", []),
]
