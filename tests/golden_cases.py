"""Golden cases (texts are ours; expectations computed from the rules in
exact decimal arithmetic). Kept = (position, type, confidence, masked)."""

GOLDEN = [
    ("G01", "", 0, [], 0.000, 0.000),
    ("G02", "   ", 0, [], 0.000, 0.000),
    ("G03", "hello world, nothing here", 0, [], 0.000, 0.180),
    ("G04", "write to bob@corp.example.org today", 1, [(9, "email", "0.65", "bob@co...le.org")], 0.190, 0.505),
    ("G05", "write to bob@mail.ru today", 2, [(9, "free_email_combo", "1.00", "bob@...l.ru"), (9, "email", "0.80", "bob@...l.ru")], 0.520, 0.835),
    ("G06", "server at 8.8.8.8 and test@test.com ok", 0, [], 0.000, 0.180),
    ("G07", "router 192.168.1.1 and 192.168.5.10 wifi", 1, [(23, "ipv4_private", "1.00", "192....5.10")], 0.302, 0.617),
    ("G08", "x login=bob; password='s3cretpw'", 2, [(2, "login_password_pair", "1.00", "login=...retpw'")], 0.328, 0.643),
    ("G09", "ping +7 (916) 123-45-67", 0, [], 0.000, 0.180),
    ("G10", "ping +7(916)123-45-67 now", 1, [(5, "phone_ru", "0.75", "+7(916...-45-67")], 0.226, 0.541),
    ("G11", "card 4276 1234 5678 9012 visa", 1, [(5, "card_number", "1.00", "4276 1...8 9012")], 0.323, 0.638),
    ("G12", "token eyJhbGciOi.eyJzdWIi.abc-_1 bearer", 1, [(6, "jwt_token", "1.00", "eyJhbG...abc-_1")], 0.317, 0.632),
    ("G13", "set api_key='ABCDEFGHIJKLMNOPQRSTUVWX'", 2, [(4, "api_key", "1.00", "api_ke...TUVWX'")], 0.316, 0.631),
    ("G14", "Паспорт 4510 123456", 4, [(0, "passport_rf", "1.00", "Паспор...123456"), (0, "passport_mention", "0.45", "Паспорт")], 0.520, 0.992),
    ("G15", "данные: паспорт 4510 123456 сотрудника", 4, [(8, "passport_rf", "1.00", "паспор...123456"), (8, "passport_mention", "0.60", "паспорт")], 0.520, 1.000),
    ("G16", "мой СНИЛС 112-233-445 95", 1, [(10, "snils", "1.00", "112-23...445 95")], 0.317, 0.632),
    ("G17", "код 7707083893 и 500100732259", 4, [(4, "passport_series_number", "0.96", "7707...3893")], 0.322, 0.902),
    ("G18", "наш иванов иван иванович дома", 3, [(0, "fio_address_combo", "1.00", "наш ив...ич дом"), (0, "fio", "0.45", "наш ив...в иван"), (25, "address", "0.80", "дома")], 0.530, 0.845),
    ("G19", "тел. Петров Пётр Петрович 89161234567", 3, [(5, "fio_phone_combo", "1.00", "Петров...234567"), (26, "phone_ru", "0.75", "8916...4567")], 0.520, 0.835),
    ("G20", "born 12.05.1990 ok", 1, [(5, "birth_date", "0.65", "12.0...1990")], 0.202, 0.422),
    ("G21", "seed: apple apple apple apple apple apple apple apple apple apple apple apple", 1, [(0, "seed_phrase", "1.00", "seed: ... apple")], 0.332, 0.647),
    ("G22", "- user: root", 1, [(0, "config_fragment", "0.85", "- us...root")], 0.261, 0.481),
    ("G23", "пришли фото паспорта сотрудника", 3, [(0, "passport_series_number_request", "1.00", "пришли"), (0, "fio", "0.75", "пришли...спорта")], 0.520, 1.000),
    ("G24", "xx -----BEGIN RSA PRIVATE KEY-----\nAB\n-----END RSA PRIVATE KEY-----", 1, [(3, "private_key", "1.00", "-----B...Y-----")], 0.328, 0.643),
    ("G25", "user pass hunter22 ok", 1, [(5, "password_loose", "0.80", "pass h...nter22")], 0.248, 0.563),
    ("G26", "see paspport 4510 123456 x", 2, [(13, "passport_series_number", "0.96", "4510...3456")], 0.322, 0.902),
    ("G27", "живу ул. Ленина, д. 5, кв. 7", 1, [(5, "address", "0.80", "ул. Ле... кв. 7")], 0.252, 0.567),
    ("G28", "cfg {db_password: 'x'} end", 2, [(4, "config_fragment", "0.85", "{db_pa...: 'x'}"), (8, "password", "0.95", "passwo...: 'x'}")], 0.520, 0.835),
    ("G29", "серия 4510 номер 123456", 5, [(0, "passport_series_number_request", "1.00", "серия"), (0, "passport_series_number", "1.00", "серия ...123456"), (0, "passport_mention", "0.45", "серия")], 0.530, 1.000),
    ("G30", "Паспорт 4510 123456 сотрудника Иванов Иван Иванович, тел +7(916)123-45-67 мой логин: vasya пароль: qwerty123", 10,
     [(0, "passport_rf", "1.00", "Паспор...123456"), (0, "pdn_auth_combo", "1.00", "Паспор... логин"), (0, "passport_mention", "1.00", "Паспорт"),
      (20, "fio_phone_combo", "1.00", "сотруд...-45-67"), (57, "phone_ru", "0.90", "+7(916...-45-67"), (78, "login_password_pair", "1.00", "логин:...rty123")], 0.560, 1.000),
    ("G31", "call a@b.co 10.1.2.3 card 4276 1234 5678 9012 on 12.05.1990 or 112-233-445 95 jwt eyJhbGciOi.eyJzdWIi.abc", 6,
     [(5, "email", "0.65", "a@b.co"), (12, "ipv4_private", "0.85", "10.1.2.3"), (26, "card_number", "1.00", "4276 1...8 9012"),
      (49, "birth_date", "0.65", "12.0...1990"), (63, "snils", "0.90", "112-23...445 95"), (82, "jwt_token", "1.00", "eyJhbG...Ii.abc")], 0.560, 0.875),
    ("G32", "вот Иванов Иван Иванович - паспорт у него", 3, [(0, "passport_fio_combo", "1.00", "вот Ив...аспорт"), (0, "fio", "0.60", "вот Ив...в Иван"), (27, "passport_mention", "0.45", "паспорт")], 0.530, 1.000),
    ("G33", "сумма 500100732259 руб", 1, [(6, "inn", "0.90", "5001...2259")], 0.286, 0.601),
    ("G34", "a 4510 123456 zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz 4511 654321 b", 4,
     [(2, "passport_series_number", "0.96", "4510...3456"), (75, "passport_number", "0.93", "4511...4321")], 0.436, 1.000),
]
