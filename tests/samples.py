"""Messages written for the tests."""

CLEAN = """Return-Path: <ann@example.com>
Received: from mail.example.com (mail.example.com [203.0.113.9]) by mx.receiver.test with ESMTP; Mon, 15 Jan 2024 10:00:05 +0000
Received: from [192.168.1.23] (helo=[192.168.1.23]) by mail.example.com; Mon, 15 Jan 2024 10:00:01 +0000
Authentication-Results: mx.receiver.test; spf=pass (sender ok; really) smtp.mailfrom=ann@example.com; dkim=pass header.d=example.com; dmarc=pass header.from=example.com
DKIM-Signature: v=1; a=rsa-sha256; d=example.com; s=sel; bh=x; b=y
From: "Ann Example" <Ann@Example.com>
To: bob@receiver.test
Subject: =?UTF-8?Q?Gr=C3=BC=C3=9Fe?= from
 the coast
Date: Mon, 15 Jan 2024 10:00:00 +0000
Message-ID: <1@example.com>
Content-Type: text/plain; charset=utf-8

Hello Bob, see https://www.example.com/page for the pictures.
"""

FAKE = """Return-Path: <x@evil.ru>
Received: from evil.ru (evil.ru [198.51.100.50]) by mx.receiver.test; Mon, 15 Jan 2024 11:00:05 +0000
Authentication-Results: mx.receiver.test; spf=fail smtp.mailfrom=x@evil.ru; dkim=none; dmarc=fail header.from=paypa1.com
From: PayPal Support <security@paypa1.com>
Reply-To: help@gmail.com
Subject: Invoice 4021 overdue
Message-ID: <2@evil.ru>
X-Mailer: MassSend 2
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="b1"

--b1
Content-Type: multipart/alternative; boundary=b2

--b2
Content-Type: text/html; charset=iso-8859-1
Content-Transfer-Encoding: quoted-printable

<p>Please verify your account at <a href=3D"http://paypa1-verify.top/login">https://www.paypal.com/</a>=
 caf=E9</p><form><input type=3D"password"></form>
--b2--
--b1
Content-Type: application/octet-stream; name="invoice.pdf.exe"
Content-Disposition: attachment; filename="invoice.pdf.exe"
Content-Transfer-Encoding: base64

TVqQAAMAAAAEAAAA
--b1--
"""

TWIN = FAKE.replace("Invoice 4021", "Re: Invoice 5533").replace("<2@evil.ru>", "<3@evil.ru>").replace("security@", "billing@")

WIRE = CLEAN.replace("Gr=C3=BC=C3=9Fe", "Urgent").replace("see https://www.example.com/page for the pictures", "we need a wire transfer to the new bank details; keep this confidential")

NO_MESSAGE = "just a note\n\nwithout headers\n"
