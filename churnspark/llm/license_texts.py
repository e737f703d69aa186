"""Texts of whole licence files, as templates of the licence scan."""

# The public licence texts; of the long ones the passages that tell them apart from each other.
WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = """BSD 2-Clause License. Copyright. All rights reserved. Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """ + WARRANTY
BSD_3 = BSD_2.replace("BSD 2-Clause License", "BSD 3-Clause License") + """ 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
MIT = """MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
APACHE_2 = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this
document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity"
shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.
For the purposes of this definition, "control" means (i) the power, direct or indirect, to cause the direction or management of such entity,
whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding shares, or (iii) beneficial ownership of
such entity. "You" (or "Your") shall mean an individual or Legal Entity exercising permissions granted by this License. "Source" form shall mean
the preferred form for making modifications, including but not limited to software source code, documentation source, and configuration files.
"Object" form shall mean any form resulting from mechanical transformation or translation of a Source form, including but not limited to compiled
object code, generated documentation, and conversions to other media types. "Work" shall mean the work of authorship, whether in Source or Object
form, made available under the License, as indicated by a copyright notice that is included in or attached to the work. "Derivative Works" shall
mean any work, whether in Source or Object form, that is based on (or derived from) the Work and for which the editorial revisions, annotations,
elaborations, or other modifications represent, as a whole, an original work of authorship. "Contribution" shall mean any work of authorship,
including the original version of the Work and any modifications or additions to that Work, that is intentionally submitted to Licensor for
inclusion in the Work. 2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a
perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly
display, publicly perform, sublicense, and distribute the Work and such Derivative Works. 3. Grant of Patent License. If You institute patent
litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work constitutes direct or contributory
patent infringement, then any patent licenses granted to You under this License for that Work shall terminate as of the date such litigation is
filed. 4. Redistribution. You must cause any modified files to carry prominent notices stating that You changed the files; You must retain all
copyright, patent, trademark, and attribution notices; If the Work includes a "NOTICE" text file, Derivative Works must include a readable copy of
the attribution notices. 5. Submission of Contributions. 6. Trademarks. 7. Disclaimer of Warranty. Unless required by applicable law or agreed to in
writing, Licensor provides the Work on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including TITLE,
NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE. You are solely responsible for determining the appropriateness of using or
redistributing the Work and assume any risks associated with Your exercise of permissions under this License. 8. Limitation of Liability. In no event
and under no legal theory, whether in tort (including negligence), contract, or otherwise, shall any Contributor be liable to You for damages,
including any direct, indirect, special, incidental, or consequential damages of any character, loss of goodwill, work stoppage, computer failure or
malfunction. 9. Accepting Warranty or Additional Liability. You may choose to offer, and charge a fee for, acceptance of support, warranty, indemnity."""
GPL = """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble. The licenses for
most software are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to
guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all its users. When we speak of free
software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute
copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the
software or use pieces of it in new free programs, and that you know you can do these things. To protect your rights, we need to prevent others from
denying you these rights or asking you to surrender the rights. For example, if you distribute copies of such a program, whether gratis or for a fee,
you must pass on to the recipients the same freedoms that you received. You must make sure that they, too, receive or can get the source code. And you
must show them these terms so they know their rights. For the developers' and authors' protection, the GPL clearly explains that there is no warranty
for this free software. Finally, every program is threatened constantly by software patents. The precise terms and conditions for copying, distribution
and modification follow. TERMS AND CONDITIONS. You may copy and distribute verbatim copies of the Program's source code as you receive it, in any
medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices; give all
recipients a copy of this License along with the Program. You may convey a work based on the Program, or the modifications to produce it from the
Program, in the form of source code. THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW. THE ENTIRE RISK AS TO THE QUALITY
AND PERFORMANCE OF THE PROGRAM IS WITH YOU. SHOULD THE PROGRAM PROVE DEFECTIVE, YOU ASSUME THE COST OF ALL NECESSARY SERVICING, REPAIR OR CORRECTION.
IN NO EVENT UNLESS REQUIRED BY APPLICABLE LAW OR AGREED TO IN WRITING WILL ANY COPYRIGHT HOLDER BE LIABLE TO YOU FOR DAMAGES, INCLUDING ANY GENERAL,
SPECIAL, INCIDENTAL OR CONSEQUENTIAL DAMAGES ARISING OUT OF THE USE OR INABILITY TO USE THE PROGRAM (INCLUDING BUT NOT LIMITED TO LOSS OF DATA OR DATA
BEING RENDERED INACCURATE). How to Apply These Terms to Your New Programs. This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. """
GPL_2 = "GNU GENERAL PUBLIC LICENSE Version 2, June 1991. " + GPL + """Activities other than copying, distribution and modification are not covered by this
License; they are outside its scope. The act of running the Program is not restricted. You may modify your copy or copies of the Program or any portion of
it, thus forming a work based on the Program. Ty Coon, President of Vice. Gnomovision comes with ABSOLUTELY NO WARRANTY; Yoyodyne, Inc. hereby disclaims all
copyright interest in the program written by James Hacker."""
GPL_3 = "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. " + GPL + """To propagate a work means to do anything with it that, without permission, would make you
directly or secondarily liable for infringement, except executing it on a computer. To convey a work means any kind of propagation that enables other parties to
make or receive copies. Corresponding Source means all the source code needed to generate, install, and run the object code, including scripts, interface
definition files, shared libraries and dynamically linked subprograms. Object code in a User Product, Installation Information, additional permissions, automatic
licensing of downstream recipients, patents, essential patent claims, discriminatory patent license, tivoization, anti-circumvention, covered work, entity
transaction. No covered work shall be deemed part of an effective technological measure under the WIPO copyright treaty."""
MPL_2 = """Mozilla Public License Version 2.0. 1. Definitions. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns
Covered Software. Contributor Version means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's
Contribution. Covered Software means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source
Code Form, and Modifications of such Source Code Form. Incompatible With Secondary Licenses. Larger Work means a work that combines Covered Software with other
material, in a separate file or files, that is not Covered Software. Licensable means having the right to grant, to the maximum extent possible, whether at the time
of the initial grant or subsequently, any and all of the rights conveyed by this License. Patent Claims of a Contributor. 2. License Grants and Conditions. Each
Contributor hereby grants You a world-wide, royalty-free, non-exclusive license. 3. Responsibilities. Distribution of Source Form. All distribution of Covered
Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License. Distribution of
Executable Form. Inability to Comply Due to Statute or Regulation. Termination. Covered Software is provided under this License on an "as is" basis, without warranty
of any kind. Under no circumstances and under no legal theory shall any Contributor be liable. Litigation. Miscellaneous. Versions of the License. Exhibit A, Source
Code Form License Notice. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. For more information, please refer to
unlicense.org"""

FILE_TEMPLATES = (
    ("Apache-2.0", APACHE_2), ("BSD-2-Clause", BSD_2), ("BSD-3-Clause", BSD_3), ("GPL-2.0", GPL_2), ("GPL-3.0", GPL_3), ("ISC", ISC), ("MIT", MIT),
    ("MPL-2.0", MPL_2), ("Unlicense", UNLICENSE),
)
