"""Fixed values shared by the operators.

Everything in this module is data: labels, keyword lists, rule points and
distribution tables that decide results and therefore have to be exactly these.
"""

from __future__ import annotations

# --- Fixed values: journal criteria, in reporting order --------------------------------------
# (flag column, weight column, label shown to the user)
CRITERIA = [
    ("profit_impact", "w_profit_impact", "Impatto sull'utile"),
    ("over_ten_times_mean", "w_over_ten_times_mean", "> 10× media"),
    ("over_performance_materiality", "w_over_performance_materiality", "Oltre performance materiality"),
    ("round_amount", "w_round_amount", "Importo a cifra tonda"),
    ("weekend", "w_weekend", "Weekend"),
    ("holiday", "w_holiday", "Festività"),
    ("out_of_hours", "w_out_of_hours", "Fuori orario"),
    ("backdated", "w_backdated", "Registrazione retrodatata"),
    ("unauthorised_user", "w_unauthorised_user", "Staff non autorizzato"),
    ("related_party_text", "w_related_party_text", "Parte correlata"),
    ("blank_description", "w_blank_description", "Descrizione vuota"),
    ("rare_account", "w_rare_account", "Conto insolito/raro"),
    ("intragroup_account", "w_intragroup_account", "Conto infragruppo/parte correlata"),
]

# --- Fixed values: countries with a calendar, their weekend days (Monday = 0), covered years ---
WEEKEND_DAYS = {
    "IT": [5, 6],
    "DE": [5, 6],
    "FR": [5, 6],
    "ES": [5, 6],
    "IL": [4, 5],
    "US": [5, 6],
    "MT": [5, 6],
    "IE": [5, 6],
    "CY": [5, 6],
}
CALENDAR_FIRST_YEAR = 2024
CALENDAR_LAST_YEAR = 2030

# --- Fixed values: first-digit shares and thresholds of the entry tests -----------------------
FIRST_DIGIT_SHARES = {
    "1": "0.301",
    "2": "0.176",
    "3": "0.125",
    "4": "0.097",
    "5": "0.079",
    "6": "0.067",
    "7": "0.058",
    "8": "0.051",
    "9": "0.046",
}

# --- Fixed values: candidate header names per logical field of a journal file ------------------
HEADER_CANDIDATES = {
    "entry_number": ["N. Reg.", "Numero", "Nr.", "Num", "N°", "Registrazione"],
    "registration_date": ["Data Reg.", "Data", "Data Registrazione", "Dt. Reg."],
    "document_date": ["Data Doc.", "Data Documento", "Dt. Doc."],
    "description": ["Descrizione", "Causale", "Desc.", "Testo"],
    "document_ref": ["Rif. Doc.", "N. Doc.", "Documento", "Fattura"],
    "account_code": ["Conto", "Cod. Conto", "Codice", "C/C"],
    "account_name": ["Descrizione Conto", "Nome Conto", "Desc. Conto"],
    "debit": ["Dare", "D", "Addebito", "Debit"],
    "credit": ["Avere", "A", "Accredito", "Credit"],
}

# --- Fixed values: header aliases of a trial balance ------------------------------------------
TRIAL_BALANCE_ALIASES = {
    "account": ["conto", "account", "acc nb", "codice", "coge"],
    "name": ["descrizione", "account name", "nome"],
    "amount": ["saldo", "importo", "amount", "saldo periodo"],
    "prior": ["saldo n-1", "prior", "saldo precedente"],
}

# --- Fixed values: file names, folders and extensions of a document folder ---------------------
JUNK_NAMES = [".ds_store", "thumbs.db", "desktop.ini"]
JUNK_PREFIXES = ["~$", "._", "."]
TEMPLATE_NAME_PATTERN = r"(?i)^template wps|template.*wps|wps verifica trimestrale|documenti mancanti"
SKIPPED_FOLDERS = [".git", "node_modules", "__pycache__", ".venv", "output", "0_Richiesta", "0_richiesta", "storage"]
ALLOWED_EXTENSIONS = [
    ".pdf", ".xlsx", ".xls", ".xlsm", ".csv", ".txt", ".xml", ".json",
    ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".doc", ".docx",
]

# --- Fixed values: the checklist, in catalogue order: (item, label, what is needed) -----------
CATALOGUE = [
    ("A.1", "Cambiamenti SCI / sistema contabile-amministrativo",
     "Serve una nota o file su cambiamenti del sistema di controllo interno / organigramma."),
    ("A.2", "Operazioni straordinarie, contratti, passività potenziali",
     "Servono atti o mail su operazioni straordinarie, contratti, passività potenziali."),
    ("A.3", "Cartelle, avvisi bonari, comunicazioni AE/INPS",
     "Servono cartelle, avvisi bonari o comunicazioni AE/INPS del trimestre."),
    ("A.4", "Transazioni finanziarie non ordinarie",
     "Servono evidenze di transazioni finanziarie non ordinarie (nuovi prestiti, M&A)."),
    ("B.1", "Bilancino di verifica",
     "Serve il bilancino di verifica (Excel o TXT) alla data di fine trimestre."),
    ("B.2", "CE gestionale vs budget",
     "Serve il conto economico gestionale confrontato con il budget."),
    ("B.3", "Budget e cashflow",
     "Servono il budget e, se c'è, il cashflow a 6–12 mesi."),
    ("B.4", "Libro giornale provvisorio / mastrini",
     "Serve l'estrazione libro giornale provvisorio o i mastrini in TXT/Excel del trimestre."),
    ("C.1", "Verbali assemblee soci",
     "Manca la copia dei verbali delle assemblee soci."),
    ("C.2", "Verbali Consiglio di amministrazione",
     "Manca la copia dei verbali del Consiglio di amministrazione."),
    ("C.3", "Verbali Collegio sindacale",
     "Manca la copia dei verbali del Collegio sindacale."),
    ("C.4", "Libro soci",
     "Mancano annotazioni o visure del libro soci."),
    ("D.1", "Libro giornale definitivo (bollato)",
     "Serve il libro giornale definitivo (bollato), distinto dal provvisorio."),
    ("D.2", "Libro inventari",
     "Serve il libro inventari aggiornato."),
    ("D.3", "Registri IVA",
     "Servono i registri IVA (acquisti, vendite, corrispettivi) del periodo."),
    ("E.1", "Quietanze F24",
     "Servono le quietanze F24 del trimestre (file con F24 o quietanza nel nome)."),
    ("E.2", "Fondi previdenziali",
     "Servono le ricevute fondi (Alifond, FASA, Previndai, Enasarco, FASI, Anima…)."),
    ("E.3", "LIPE — liquidazione periodica IVA",
     "Manca la LIPE (comunicazione liquidazione periodica IVA)."),
    ("E.4", "Dichiarazione annuale IVA",
     "Manca la dichiarazione IVA annuale o la ricevuta di trasmissione."),
    ("E.5", "Intrastat",
     "Manca l'Intrastat, se l'azienda è tenuta a presentarlo."),
    ("F.1", "Estratti conto bancari",
     "Servono gli estratti conto bancari di fine trimestre."),
    ("F.2", "Riconciliazioni bancarie",
     "Mancano le riconciliazioni bancarie / dump DocFinance saldi."),
    ("F.3", "Centrale Rischi",
     "Manca la Centrale Rischi."),
    ("G.1", "Cedolini / LUL / prima nota personale",
     "Servono cedolini, LUL o prima nota del personale (non solo il contabile di pagamento)."),
    ("G.2", "Contabile pagamento stipendi",
     "Serve il contabile di pagamento stipendi del trimestre."),
]
DEFAULT_NEED = "Documento non trovato in cartella."

# --- Fixed values: work-paper sections and the checklist items each one rests on --------------
SECTION_ITEMS = {
    "A": ["A.1", "A.2", "A.3"],
    "B": ["B.4", "D.1", "D.2", "D.3"],
    "C": ["E.1", "E.2", "E.3", "E.4", "E.5", "G.1", "G.2"],
    "D": ["B.4"],
    "E": ["F.1", "F.2", "F.3", "A.4"],
    "F": ["C.1", "C.2", "C.3", "C.4"],
    "G": ["B.1", "B.2", "B.3"],
    "H": [],
    "I": ["A.2", "A.4"],
}
JUDGEMENT_SECTIONS = ["A", "D", "H", "I"]
JUDGEMENT_NOTE_ITEMS = {"A": ["A.1", "A.2", "A.3", "A.4"], "D": ["B.4"], "H": [], "I": ["A.2", "A.4"]}
SECTIONS_NEEDING_FIGURES = ["C", "E", "G"]

# --- Fixed values: classification keywords and points -----------------------------------------
NAME_RULES = [
    ("E.1", "10", ["f24", "quietanza", "imposta di bollo", "imposta bollo"]),
    ("E.2", "10", ["enasarco", "previmoda", "sanimoda", "alifond", "fasa", "previndai", "fasi", "anima",
                   "previdenza complementare", "versamenti fondi", "ricevute fondi"]),
    ("E.3", "10", ["lipe", "liquidazione periodica"]),
    ("E.4", "8", ["dichiarazione iva", "iva annuale", "ricevuta di trasmissione", "d.iva", "d. iva"]),
    ("E.5", "8", ["intrastat"]),
    ("G.2", "11", ["contabile pag", "pag stip", "pagamento stipendi", "contabile stip"]),
    ("D.3", "7", ["registro iva", "iva acquisti", "iva vendite", "registro corrispettivi",
                  "registro riepilogativo", "registro ai", "registro ap", "registro ar", "registro ni",
                  "registro va", "registro vg", "registro vi", "registro vr"]),
    ("G.1", "8", ["personale aprile", "personale maggio", "personale giugno", "personale luglio",
                  "personale agosto", "personale settembre", "personale ottobre", "personale novembre",
                  "personale dicembre", "personale gen", "welfare", "cedolin", "cedolone", "amm_coll",
                  "libro unico", "lul"]),
    ("B.4", "9", ["giornale provv", "mastrini"]),
    ("B.1", "8", ["bilancino", "bilancio sap", "bil. verifica", "trial balance"]),
    ("F.2", "10", ["saldi_coge", "coge_saldi", "situazione_banche", "df_situazione", "docfinance",
                   "riconciliaz"]),
    ("F.3", "8", ["centrale rischi", "centrale_rischi"]),
    ("C.1", "8", ["assemblea", "app.ne bil", "app.ne bilancio"]),
    ("C.2", "7", ["cda", "consiglio di amministrazione", "esame 1", "quater", "marcante"]),
    ("C.3", "7", ["collegio sindacale", "sindaci"]),
    ("C.4", "6", ["libro soci"]),
    ("D.1", "12", ["giornale definitivo", "giornale bollato", "libro giornale"]),
    ("F.1", "6", ["estratto", "estratti", "e/c", "bnl_", "credem", "sella", "unicr", "unicredit", "intesa",
                  "asti_", "commerz", "biver", "passadore", "bpm", "deutsche", "bper", "mediobanca",
                  "allianz", "piemonte", "mps"]),
]
FOLDER_RULES = [
    ("G.2", "3.5", ["/g.2/"]),
    ("G.1", "3.5", ["/g.1/", "g personale"]),
    ("F.1", "3.0", ["f_banche", "f banche", "/banche/", "ec 30."]),
    ("E.1", "1.5", ["e_adempimenti"]),
    ("C.2", "1.2", ["c_libri sociali", "c_libri"]),
    ("B.1", "2.0", ["b_bilancio"]),
    ("D.1", "4.0", ["d libri fiscali", "libri fiscali"]),
    ("D.3", "2.0", ["d libri fiscali", "libri fiscali"]),
    ("G.1", "1.5", ["g_personale"]),
]
ITEM_HINTS = {
    "B.1": ["bilancino", "trial balance", "bilancio di verifica",
            "bilancino", "trial balance", "piano dei conti", "saldo dare", "saldo avere"],
    "B.2": ["gestionale", "budget", "conto economico"],
    "B.3": ["budget", "cashflow", "tesoreria"],
    "B.4": ["giornale", "mastrini", "prima nota", "libro giornale", "mastrino", "mastrini"],
    "C.1": ["verbale assemblea", "assemblea soci", "assemblea", "verbale assemblea"],
    "C.2": ["verbale cda", "consiglio di amministrazione", "cda", "consiglio di amministrazione", "verbale cda"],
    "C.3": ["verbale collegio", "sindaci", "collegio sindacale", "sindaci"],
    "C.4": ["libro soci"],
    "D.1": ["giornale definitivo", "bollato"],
    "D.2": ["libro inventari"],
    "D.3": ["registro iva", "registro iva", "iva acquisti", "iva vendite"],
    "E.1": ["f24", "quietanza", "delega f24",
            "f24", "quietanza", "delega unica", "agenzia entrate", "protocollo telematico"],
    "E.2": ["alifond", "fasa", "previndai", "anima", "fasi", "enasarco"],
    "E.3": ["lipe", "liquidazione iva"],
    "E.4": ["dichiarazione iva", "iva annuale"],
    "E.5": ["intrastat"],
    "F.1": ["estratto conto", "e/c", "estratto", "estratti", "e/c", "iban", "saldo contabile",
            "intesa", "unicredit", "unicr", "bpm", "bnl", "mps", "paschi", "piemonte", "credem", "deutsche",
            "mediobanca", "allianz", "bper", "passadore", "sella", "asti", "commerz", "biver"],
    "F.2": ["riconciliazione", "bank rec"],
    "F.3": ["centrale rischi"],
    "G.1": ["cedolino", "cedolone", "lul", "prima nota", "cedolino", "cedolone", "lul", "libro unico"],
    "G.2": ["pagamento stipendi", "bonifico stipendi"],
}
HINT_POINTS_NAME = "2.5"
HINT_POINTS_TEXT = "0.8"

# --- Fixed values: bank aliases, first match wins ---------------------------------------------
BANK_ALIASES = [
    ("intesa", "INTESA SANPAOLO SPA"),
    ("unicredit", "UNICREDIT SPA"),
    ("unicr", "UNICREDIT SPA"),
    ("unicred", "UNICREDIT SPA"),
    ("bpm", "BANCO BPM SPA"),
    ("bpn", "BANCO BPM / BPN"),
    ("bnl", "BNL GRUPPO BNP PARIBAS"),
    ("paribas", "BNP PARIBAS"),
    ("paschi", "MONTE DEI PASCHI DI SIENA"),
    ("mps", "MONTE DEI PASCHI DI SIENA"),
    ("piemonte", "BANCA DEL PIEMONTE S.P.A."),
    ("euromobiliare", "CREDEM EUROMOBILIARE SPA"),
    ("credem", "CREDITO EMILIANO SPA"),
    ("deutsche", "DEUTSCHE BANK"),
    ("mediobanca", "MEDIOBANCA SPA"),
    ("allianz", "ALLIANZ BANK SPA"),
    ("bper", "BPER BANCA SPA"),
    ("passadore", "BANCA PASSADORE"),
    ("sella", "BANCA SELLA SPA"),
    ("asti", "BANCA DI ASTI / BIVER"),
    ("biver", "BANCA DI ASTI / BIVER"),
    ("commerz", "COMMERZBANK"),
    ("bulbank", "UNICREDIT BULBANK"),
]
UNKNOWN_BANK = "CONTO BANCARIO"

# --- Fixed values: month names ------------------------------------------------------------------
MONTHS = [
    "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno",
    "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre",
]
MONTH_PREFIXES = ["gen", "feb", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic"]
