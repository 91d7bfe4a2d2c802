"""Invented mailings that hold the cases the operators have to tell apart."""

from __future__ import annotations

BASE = """<!DOCTYPE html>
<!-- Campaña de prueba - Carta 1
     ASUNTO: Ven a vernos
     PREHEADER: Abrimos el lunes -->
<html lang="es">
<head>
<title>Ven a
 vernos</title>
<link href="https://fonts.example.org/css?family=Lato" rel="stylesheet">
<style>
@import url(extra.css);
@media only screen and (max-width:600px){
 .big{font-size:30px!important}
 .big{line-height:32px!important}
 .pad{padding:0 18px}
 .unused{background:url(fondo.png)}
}
</style>
<script>var a = "<p>no</p> .fake";</script>
</head>
<body style="margin:0;background-color:#FAFAFA;">
<!-- Avance -->
<div style="display:none;max-height:0;color:#fafafa;">Abrimos <b>el lunes</b></div>
<!-- Cabecera -->
<table role="presentation"><tr><td class="pad" style="font-family:'Gill Sans', Arial;color:#102030;">
<table><tr><td><table><tr><td><table><tr><td><img src="https://img.example.org/logo.png" alt="Logo" width="160"></td></tr></table></td></tr></table></td></tr></table>
<h1 class="big pad">Hola</h1><p class="">Primera &amp; segunda &nbsp;l&iacute;nea. &#123456;</p>
<a href="https://www.example.org/inicio">Entrar</a>
<a class="big" href="https://files.example.net/a-1.pdf">Antes</a> <a href="https://files.example.net/b-1.pdf"><strong>Después</strong></a>
<a href='https://files.example.net/a-2.pdf'>Antes</a><a href=https://files.example.net/b-2.pdf>Después</a>
<a href="https://files.example.net/a-3.pdf">Antes</a><a href="/otro">Otro</a><a href="https://files.example.net/b-3.pdf">Después</a>
<a name="ancla">sin destino</a>
<p>Desde 40 páginas por 250 € (6,25 €/pág.), 10 páginas = 80 €, o 1.250,50&nbsp;&euro; al año. 3.817 visitas.</p>
<a href="mailto:hola@example.org?subject=Quiero%20m%C3%A1s+info">Escribir</a>
<a href="mailto:hola@example.org">Correo</a>
<a href="tel:+34000000000">Llamar</a>
<a href="{{unsubscribe_url}}" style="color:#102030">Baja</a>
</td></tr></table>
</body></html>"""

MAILS = {
    "base": BASE,
    # Another label in the head, the same text.
    "same_text": BASE.replace("Carta 1", "Carta 9").replace("<title>Ven a\n vernos", "<title>Otra"),
    "variant": BASE.replace("Primera &amp; segunda", "Tercera"),
    "bare": '<html lang="en"><body><table><tr><td><img src="x.png"><p>Short note {{ first_name }}</p>'
    '<a href="mailto:a@example.org?cc=b@example.org&amp;subject=50%ZZ">Mail</a></body></html>',
    "empty": "\n",
}
