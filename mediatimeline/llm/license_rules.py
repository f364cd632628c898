"""The signature rules, in order of priority: label, confidence, regex over lower-case words parted by single blanks.

The word in angle brackets is the rule's keyword: a rule is tried only where its keyword stands.
"""

TEXT = r"""
mit 1.0 under the <mit> license
apache-2 1.0 <apache> license version 2
cc-by-nc 1.0 <cc> by nc
apache-2 0.99 licensed under the <apache> license version 2 0(?: the license)?
apache-2 0.98 spdx license identifier <apache> 2 0
apache-2 0.97 <apache> software license version 2(?: 0)?
apache-2 0.97 <apache> license 2 0
apache-2 0.95 <apache> public license 2 0
apache-2 0.95 <apache> 2 0 licen[cs]ed?
apache-2 0.95 <apache> org licenses license 2 0
apache-2 0.9 <apache> v2 licen[cs]e
apache-2 0.9 asl 2 0 <apache>
apache-1-1 0.97 <apache> software license version 1 1
apache-1-1 0.95 <apache> license (?:version )?1 1
apache-1-0 0.95 <apache> license (?:version )?1 0
apache 0.8 under the <apache> licen[cs]e
apache 0.7 <apache> licen[cs]ed?
mit 0.99 spdx license identifier <mit>
mit 0.98 released under the <mit> licen[cs]e
mit 0.98 licensed under (?:the )?<mit>
mit 0.97 the <mit> licen[cs]e mit
mit 0.97 permission is hereby granted free of <charge> to any person obtaining a copy
mit 0.95 <mit> x11 licen[cs]e
mit 0.95 <mit> expat licen[cs]e
mit 0.95 <expat> licen[cs]e
mit 0.9 <mit> style licen[cs]e
mit 0.9 <mit> licen[cs]e
mit 0.9 <mit> licen[cs]ed
mit 0.9 opensource org licenses <mit>
mit 0.8 licen[cs]e <mit>
mit-0 0.97 <mit> no attribution
mit-0 0.9 <mit> 0 licen[cs]e
x11 0.9 <x11> licen[cs]e
bsd-2-clause 0.98 spdx license identifier <bsd> 2 clause
bsd-2-clause 0.95 <bsd> 2 clause(?: licen[cs]e)?
bsd-2-clause 0.95 2 clause <bsd>(?: licen[cs]e)?
bsd-2-clause 0.95 simplified <bsd>(?: licen[cs]e)?
bsd-2-clause 0.9 <freebsd> licen[cs]e
bsd-3-clause 0.98 spdx license identifier <bsd> 3 clause
bsd-3-clause 0.95 <bsd> 3 clause(?: licen[cs]e)?
bsd-3-clause 0.95 3 clause <bsd>(?: licen[cs]e)?
bsd-3-clause 0.95 (?:new|revised|modified) <bsd>(?: licen[cs]e)?
bsd-4-clause 0.95 <bsd> 4 clause(?: licen[cs]e)?
bsd-4-clause 0.95 4 clause <bsd>(?: licen[cs]e)?
bsd-4-clause 0.9 original <bsd> licen[cs]e
0bsd 0.95 <0bsd>(?: licen[cs]e)?
0bsd 0.9 zero clause <bsd>
bsd 0.9 <redistribution> and use in source and binary forms with or without modification
bsd 0.85 <bsd> style licen[cs]e
bsd 0.8 <bsd> licen[cs]ed?
bsd 0.8 under the <bsd>
isc 0.95 <isc> licen[cs]e
isc 0.95 spdx license identifier <isc>
isc 0.9 permission to use copy modify and or distribute this software for any <purpose> with or without fee
gpl-1 0.95 <gpl> 1 0(?: only| or later)?
gpl-2-or-later 0.97 <gpl> 2 0 or later
gpl-2-or-later 0.95 <gpl> version 2 or (?:any )?later
gpl-2-or-later 0.95 <gplv2> or later
gpl-2 0.97 spdx license identifier <gpl> 2 0(?: only)?
gpl-2 0.95 gnu general <public> licen[cs]e version 2
gpl-2 0.95 gnu general <public> licen[cs]e v2
gpl-2 0.95 <gpl> (?:version )?2(?: 0)?(?: only)?
gpl-2 0.9 <gplv2>(?: licen[cs]e)?
gpl-2 0.9 <gpl2>
gpl-3-or-later 0.97 <gpl> 3 0 or later
gpl-3-or-later 0.95 <gpl> version 3 or (?:any )?later
gpl-3-or-later 0.95 <gplv3> or later
gpl-3 0.97 spdx license identifier <gpl> 3 0(?: only)?
gpl-3 0.95 gnu general <public> licen[cs]e version 3
gpl-3 0.95 gnu general <public> licen[cs]e v3
gpl-3 0.95 <gpl> (?:version )?3(?: 0)?(?: only)?
gpl-3 0.9 <gplv3>(?: licen[cs]e)?
gpl-3 0.9 <gpl3>
gpl 0.95 under the terms of the gnu general <public> licen[cs]e
gpl 0.9 gnu general <public> licen[cs]e
gpl 0.85 gnu <gpl>
gpl 0.85 <gpl> licen[cs]ed?
gpl 0.85 under the <gpl>
gpl 0.8 free software you can redistribute it and or modify it under the terms of the <gnu>
lgpl-2-1 0.97 spdx license identifier <lgpl> 2 1(?: only| or later)?
lgpl-2-1 0.95 gnu lesser general <public> licen[cs]e version 2 1
lgpl-2-1 0.95 <lgpl> (?:version )?2 1(?: or later)?
lgpl-2 0.95 gnu library general <public> licen[cs]e
lgpl-2 0.9 <lgpl> (?:version )?2(?: 0)?
lgpl-2 0.9 <lgplv2>
lgpl-3 0.97 spdx license identifier <lgpl> 3 0(?: only| or later)?
lgpl-3 0.95 gnu lesser general <public> licen[cs]e version 3
lgpl-3 0.95 <lgpl> (?:version )?3(?: 0)?(?: or later)?
lgpl-3 0.9 <lgplv3>
lgpl 0.9 gnu lesser general <public> licen[cs]e
lgpl 0.85 lesser general <public> licen[cs]e
lgpl 0.85 gnu <lgpl>
lgpl 0.85 <lgpl> licen[cs]ed?
lgpl 0.85 under the <lgpl>
agpl-3 0.97 spdx license identifier <agpl> 3 0(?: only| or later)?
agpl-3 0.95 gnu affero general <public> licen[cs]e(?: version 3)?
agpl-3 0.95 <agpl> (?:version )?3(?: 0)?(?: or later)?
agpl-3 0.9 <agplv3>
agpl 0.85 <agpl> licen[cs]ed?
agpl 0.85 affero general <public> licen[cs]e
gfdl 0.95 gnu free <documentation> licen[cs]e(?: version 1 [123])?
gfdl 0.95 <gfdl> (?:version )?1 [123]
gfdl 0.85 <gfdl>(?: licen[cs]e)?
mpl-1-1 0.95 <mozilla> public licen[cs]e (?:version )?1 1
mpl-1-1 0.95 <mpl> (?:version )?1 1
mpl-2 0.97 spdx license identifier <mpl> 2 0
mpl-2 0.95 <mozilla> public licen[cs]e (?:version |v )?2(?: 0)?
mpl-2 0.95 <mpl> (?:version )?2(?: 0)?
mpl 0.85 <mozilla> public licen[cs]e
mpl 0.8 <mpl> licen[cs]ed?
epl-1 0.95 <eclipse> public licen[cs]e (?:version |v )?1(?: 0)?
epl-1 0.95 <epl> (?:version )?1 0
epl-2 0.95 <eclipse> public licen[cs]e (?:version |v )?2(?: 0)?
epl-2 0.95 <epl> (?:version )?2 0
epl 0.85 <eclipse> public licen[cs]e
edl 0.9 <eclipse> distribution licen[cs]e
eupl 0.95 european union <public> licen[cs]e
eupl 0.9 <eupl> (?:version )?1 [0-2]
cddl 0.95 common <development> and distribution licen[cs]e
cddl 0.9 <cddl>(?: (?:version )?1 [01])?
cpl 0.95 common <public> licen[cs]e (?:version )?1 0
ipl 0.9 ibm <public> licen[cs]e
apsl 0.9 apple <public> source licen[cs]e
npl 0.9 netscape <public> licen[cs]e
qpl 0.9 q <public> licen[cs]e
rpl 0.9 reciprocal <public> licen[cs]e
osl-3 0.95 open <software> licen[cs]e (?:version )?3(?: 0)?
afl-3 0.95 academic <free> licen[cs]e (?:version )?3(?: 0)?
artistic-1 0.95 <artistic> licen[cs]e 1 0
artistic-2 0.95 <artistic> licen[cs]e (?:version )?2(?: 0)?
artistic 0.85 <artistic> licen[cs]e
perl 0.9 same terms as <perl>(?: itself)?
psf 0.95 <python> software foundation licen[cs]e
psf 0.9 <psf> licen[cs]e
php 0.9 <php> licen[cs]e(?: version 3)?
ruby 0.9 <ruby> licen[cs]e
boost 0.97 <boost> software licen[cs]e(?: version 1 0)?
boost 0.9 <bsl> 1 0
zlib 0.95 <zlib> libpng licen[cs]e
zlib 0.95 <zlib> licen[cs]e
libpng 0.9 <libpng> licen[cs]e
openssl 0.9 <openssl> licen[cs]e
curl 0.9 <curl> licen[cs]e
ncsa 0.95 university of illinois <ncsa> open source licen[cs]e
ncsa 0.9 <ncsa> (?:open source )?licen[cs]e
ms-pl 0.95 <microsoft> public licen[cs]e
ms-rl 0.95 <microsoft> reciprocal licen[cs]e
wtfpl 0.95 do what the fuck you want to <public> licen[cs]e
wtfpl 0.9 <wtfpl>
unlicense 0.95 <unlicense>(?: org)?
unlicense 0.9 this is free and <unencumbered> software released into the public domain
vim 0.9 <vim> licen[cs]e
sleepycat 0.9 <sleepycat> licen[cs]e
postgresql 0.9 <postgresql> licen[cs]e
ofl 0.95 sil open <font> licen[cs]e(?: (?:version )?1 1)?
ofl 0.9 open <font> licen[cs]e
ofl 0.85 <ofl> 1 1
odbl 0.95 open <database> licen[cs]e
odbl 0.9 <odbl>(?: (?:version )?1 0)?
odc-by 0.9 open data commons <attribution> licen[cs]e
pddl 0.9 public <domain> dedication and licen[cs]e
etalab 0.9 <etalab> open licen[cs]e
ogl 0.9 open <government> licen[cs]e(?: v(?:ersion)? ?[123])?
cc0 0.97 <cc0> 1 0(?: universal)?
cc0 0.9 <cc0>(?: licen[cs]e)?
cc0 0.95 <creative> commons zero
cc0 0.9 <cc> zero
cc-by-nc-sa 0.99 <cc> by nc sa(?: [1-4] 0)?
cc-by-nc-nd 0.99 <cc> by nc nd(?: [1-4] 0)?
cc-by-nc 0.98 <cc> by nc [1-4] 0
cc-by-sa 0.98 <cc> by sa(?: [1-4] 0)?
cc-by-nd 0.98 <cc> by nd(?: [1-4] 0)?
cc-by 0.95 <cc> by [1-4] 0
cc-by 0.85 <cc> by licen[cs]ed?
cc-by-nc-sa 0.97 <creative> commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: (?:international|unported))?
cc-by-nc-nd 0.97 <creative> commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?
cc-by-nc 0.97 <creative> commons attribution non ?commercial(?: [1-4] 0)?(?: (?:international|unported))?
cc-by-sa 0.97 <creative> commons attribution share ?alike(?: [1-4] 0)?(?: (?:international|unported))?
cc-by-nd 0.97 <creative> commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?
cc-by 0.95 <creative> commons attribution(?: [1-4] 0)?(?: (?:international|unported|generic))?
cc-by-nc-sa 0.97 <creativecommons> org licenses by nc sa(?: [1-4] 0)?
cc-by-nc-nd 0.97 <creativecommons> org licenses by nc nd(?: [1-4] 0)?
cc-by-nc 0.97 <creativecommons> org licenses by nc(?: [1-4] 0)?
cc-by-sa 0.97 <creativecommons> org licenses by sa(?: [1-4] 0)?
cc-by-nd 0.97 <creativecommons> org licenses by nd(?: [1-4] 0)?
cc-by 0.97 <creativecommons> org licenses by(?: [1-4] 0)?
cc0 0.97 <creativecommons> org publicdomain zero(?: 1 0)?
cc 0.7 <creative> commons licen[cs]ed?
public-domain 0.95 released into the public <domain>
public-domain 0.95 dedicated to the public <domain>
public-domain 0.9 placed in the public <domain>
public-domain 0.85 (?:is|are) in the public <domain>
public-domain 0.8 public <domain> (?:mark|work|dedication)
elastic-2 0.95 <elastic> licen[cs]e (?:version )?2(?: 0)?
sspl 0.95 server side <public> licen[cs]e
sspl 0.9 <sspl> (?:v1|1 0)
busl 0.95 <business> source licen[cs]e(?: 1 1)?
polyform 0.9 <polyform> (?:noncommercial|small business|strict|shield) licen[cs]e
commons-clause 0.9 <commons> clause licen[cs]e
llama 0.9 <llama> [234](?: [1-3])? community licen[cs]e
openrail 0.9 <openrail> ?m?(?: licen[cs]e)?
non-commercial 0.8 for non <commercial> use only
non-commercial 0.8 for <noncommercial> use only
non-commercial 0.8 not for <commercial> use
no-derivatives 0.75 may not create <derivative> works
no-redistribution 0.75 may not be <reproduced> (?:or )?distributed
no-redistribution 0.75 reproduction in whole or in part is <prohibited>
proprietary 0.9 end user <license> agreement
proprietary 0.85 <proprietary> (?:and confidential|licen[cs]e|software)
proprietary 0.8 confidential and <proprietary>
proprietary 0.8 all rights not expressly granted are <reserved>
all-rights-reserved 0.7 all rights <reserved>
some-rights-reserved 0.6 some rights <reserved>
copyright-notice 0.6 <copyright> c (?:19|20)[0-9]{2}
copyright-notice 0.5 <copyright> (?:19|20)[0-9]{2}
other-license 0.4 under the terms of the <license>
other-license 0.4 see the <license> file
other-license 0.4 spdx <license> identifier
"""


def parse(text: str = TEXT) -> list[tuple[int, str, float, str, str]]:
    """(priority, label, confidence, keyword, regex) of every rule; the first has priority 0."""
    rules = []
    for line in text.strip().splitlines():
        label, confidence, regex = line.split(" ", 2)
        rules.append((len(rules), label, float(confidence), regex[regex.index("<") + 1:regex.index(">")], regex))
    return rules
