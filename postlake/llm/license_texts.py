"""Canonical digests of whole licence texts, by license.known_licenses: full files and their terms without titles."""

# License, its first canonical words, number of words, digest.
TEXTS = (
    ("Apache-2.0", "1 definitions license", 1380, "de39a9d4f434abcc4c920c7d12dfce3c7d783e3f031da312877d77e585e32c39"),
    ("Apache-2.0", "apache license version", 1400, "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca"),
    ("Apache-2.0", "apache license version", 1571, "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Artistic-1.0-Perl", "the artistic license", 960, "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"),
    ("BSD-2-Clause", "bsd 2 clause", 188, "7e45f8f79ca20d9ea38c96d66f315822c707f6ef57e552e9baeac43d60aa3e81"),
    ("BSD-2-Clause", "bsd 2 clause", 190, "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "redistribution and use", 184, "6091119410d6d441128c7514a97969723030816ec99a6b3939b6c4dfbe349d7e"),
    ("BSD-2-Clause", "redistribution and use", 186, "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "bsd 3 clause", 218, "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71"),
    ("BSD-3-Clause", "bsd 3 clause", 220, "9d35da508bc9f8b6c079a39f033dc94a53c80ef10a0e9499c6cbf55882ee5d3d"),
    ("BSD-3-Clause", "bsd 3 clause", 221, "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "redistribution and use", 214, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "redistribution and use", 216, "db7eb212132cf8b09c0ac1aebfd4d908745eceb2821e2b49f5e3ce424d3c9293"),
    ("BSD-3-Clause", "redistribution and use", 217, "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-4-Clause", "redistribution and use", 246, "5bdde74b98f0bd261227d812d771e8e22d8a39eef5c2acf0c6d98aaf836c254d"),
    ("BSL-1.0", "permission is hereby", 205, "4f4c9e65217414246c604405ee4900201bd9f230d226fa803a0b7a1f5775bf85"),
    ("CC0-1.0", "creative commons legal", 1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CC0-1.0", "statement of purpose", 1008, "4f8ab63ace774f37529081c81e2730a88143bf70e67392bd3c3701bd0a175152"),
    ("GFDL-1.2-only", "gnu free documentation", 3305, "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3-only", "gnu free documentation", 3710, "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0-only", "gnu general public", 1641, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0-only", "gnu general public", 2067, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0-only", "preamble the license", 1604, "018aaaf7231e8a3c8e8a0800c7e593914a330040252f5dc554e1817d1a27f2d4"),
    ("GPL-2.0-only", "gnu general public", 2494, "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-2.0-only", "gnu general public", 2965, "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0-only", "preamble the licenses", 2457, "01cc17c20d67ea4b9f59b7b4bf120b581530d252eb231629f52f366cd1778a7e"),
    ("GPL-3.0-only", "gnu general public", 5219, "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("GPL-3.0-only", "gnu general public", 5662, "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("GPL-3.0-only", "preamble the gnu", 5191, "258c99ce300149287e279ba30647d284e65123c1efe38eda7c396f9e9d5c6bf0"),
    ("ISC", "isc license permission", 103, "acc16c310f36205de97961f718b87cf33e8987c1d4e716735982d00452853114"),
    ("ISC", "isc license permission", 104, "94b4e9f723d13830ec6a47b422738caee264943af1673fa32782cefd730ffc82"),
    ("ISC", "isc license permission", 116, "96ff50f68bc2cf16994bb87ee55260f5c173bafdc5449e09f53f169ea9b53562"),
    ("ISC", "permission to use", 101, "100382f94d83ebf7c27d387efa8de2343d2263e9e3fa39753947e9653a10a70d"),
    ("ISC", "permission to use", 102, "6e9dc1cd727a12354f4cef293d9d285ed81ed312d597842774d1120ac62a6dc6"),
    ("ISC", "permission to use", 114, "98758275ffcff082f52bc35770d5883467df5637c4c1a413c24abf3491c1895d"),
    ("LGPL-2.0-only", "gnu library general", 3830, "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.0-only", "gnu library general", 4165, "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.0-only", "preamble the licenses", 3768, "86875a38722956f548be8aaac4a6def4923f749e767d24f82670b219c5b32aa1"),
    ("LGPL-2.1-only", "gnu lesser general", 4030, "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-2.1-only", "gnu lesser general", 4366, "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-2.1-only", "preamble the licenses", 3961, "446a8adc2da9c55e139c3564c793b6cc9741cfe224e9d47740bda2d268025527"),
    ("LGPL-3.0-only", "gnu lesser general", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0-only", "this version of", 1202, "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a"),
    ("MIT", "mit license permission", 162, "e94a78da9df16f4a9c0a40015bfdca38db305db8c7a415fcd98a243b16607600"),
    ("MIT", "mit license permission", 165, "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "mit license permission", 169, "07a0c98d1dbf0062cedfbb5e38df91d8bd896a09ec198aa53c51fb2115592bd7"),
    ("MIT", "permission is hereby", 160, "34a7a77651e43abd07cbd9c72cb035a5ba951ada4af819f95d6ca6fcfab5813d"),
    ("MIT", "permission is hereby", 163, "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "permission is hereby", 167, "74620107d78b567f655cb06d51f930a5e0e3cd3e1a2478bc7b860e678d8e447b"),
    ("MIT", "the mit license", 164, "1a1db7ea5b6a7a16ca81364fb122204fadcc82f415045e2d7f067f4ea078e5eb"),
    ("MIT", "the mit license", 167, "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MIT", "the mit license", 171, "581c58dda46462468177d8af0224930878c4db1747d8d4e21c1067fb0f753199"),
    ("MPL-1.1", "mozilla public license", 3760, "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "1 definitions 1", 2284, "25f490dd5976f1aba2273443f5d058a49ed6a13d137c5c252bc8c71221e14b0b"),
    ("MPL-2.0", "mozilla public license", 2414, "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("Unlicense", "this is free", 200, "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
    ("Zlib", "this software is", 133, "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
)
